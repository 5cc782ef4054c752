"""Chat formatting: a finite-state machine over roles checks the order of turns and a declarative template gives segments with loss flags.

Native: DataFrame functions only. The states of the machine are "start" and the role of the last turn; the template lists
the roles that may follow each state. Every turn is begin marker + escaped text + end marker. Markers are built from control
strings; inside texts, the escape character is put after the first character of every control string and before itself, so
the output never holds a control string that a text has brought along, and ``parse`` gives back every turn exactly.

Defined results: a null text is empty; a null role is the empty role; roles that the template doesn't know get the generic
marker pair with the role's name in it; turns are taken by (turn, role, text), nulls first, so ties and repeated rows have one
result; a null conversation id is a conversation of its own; an empty table gives no rows; an order of turns that the machine
rejects is reported in ``first_bad`` (turn position from 0, or the number of turns where the end is not accepting), never dropped.
Extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    """How the turns of a role are written: begin marker, end marker, and whether the text is trained on."""

    begin: str
    end: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """A chat format. ``follows``: state to the roles that may come next; ``accepting``: states in which a conversation may end."""

    controls: tuple[str, ...]
    roles: dict[str, Turn]
    follows: dict[str, tuple[str, ...]]
    accepting: tuple[str, ...]
    #: For roles that are not listed: begin + escaped role + middle + escaped text + end.
    other: tuple[str, str, str] = field(default=("[TURN] ", " [SAYS] ", " [/TURN]"))

    def __post_init__(self) -> None:
        begins, ends = [t.begin for t in self.roles.values()] + [*self.other[:2]], [t.end for t in self.roles.values()] + [*self.other[1:]]
        for c in self.controls:
            if len(c) < 2 or ESCAPE in c:
                raise ValueError(f"control string {c!r}: two characters at least, none of them the escape character")
            for k in range(1, len(c)):  # no control string may arise where a text meets a marker
                head, tail = c[:k], c[k:]
                if any(b.endswith(head) for b in begins) or any(e.startswith(tail) for e in ends):
                    raise ValueError(f"control string {c!r} could arise at the edge of a text")
        for m in [*begins, *ends]:
            if not any(c in m for c in self.controls):
                raise ValueError(f"marker {m!r} holds no control string")
        if len({*ends}) < len(ends) or any(a != b and a.endswith(b) for a in ends for b in ends):
            raise ValueError("end markers must tell turns apart")


#: An instruction format of published chat models: users in [INST], answers closed by </s>, system turns in <<SYS>>.
INSTRUCT = Template(
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[SAYS]", "[/TURN]"),
    roles={"system": Turn("<<SYS>> ", " <</SYS>>"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s> ", " </s>", loss=True)},
    follows={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    accepting=("assistant",),
)


def _java(text: str) -> str:
    """A literal in a Java pattern."""
    return re.sub(r"([\\\[\](){}.*+?^$|<>/-])", r"\\\1", text) if text else text


def escape(text: Column, template: Template = INSTRUCT) -> Column:
    """The text with no control string in it."""
    longest_first = sorted(template.controls, key=lambda c: (-len(c), c))
    starts = "|".join(_java(c) for c in longest_first)
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.regexp_replace(doubled, F.lit(rf"(?s)(?=(?:{starts}))(.)"), F.lit(r"$1\\"))


def unescape(text: Column) -> Column:
    """The inverse of escape."""
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def _pick(role: Column, template: Template, get, other: Column) -> Column:
    out = None
    for name, turn in template.roles.items():
        out = F.when(role == name, get(turn)) if out is None else out.when(role == name, get(turn))
    return out.otherwise(other) if out is not None else other


def turns_of(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its turns in order, as structs of turn, role and text."""
    packed = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(packed)).alias("turns"))


def format_chats(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, formatted (the whole output), segments (array of kind, text, loss in output order), first_bad (null if the machine accepts).

    The text of a loss segment is escaped, as it stands in the output; segments joined in order are the output.
    """
    begin, middle, end = template.other

    def pieces(t: Column) -> Column:
        role = t["role"]
        opening = _pick(role, template, lambda x: F.lit(x.begin), F.concat(F.lit(begin), escape(role, template), F.lit(middle)))
        closing = _pick(role, template, lambda x: F.lit(x.end), F.lit(end))
        loss = _pick(role, template, lambda x: F.lit(x.loss), F.lit(False))
        part = lambda kind, text, flag: F.struct(F.lit(kind).alias("kind"), text.alias("text"), flag.alias("loss"))
        return F.array(part("marker", opening, F.lit(False)), part("text", escape(t["text"], template), loss), part("marker", closing, F.lit(False)))

    allowed = F.array(*(F.lit(f"{a}\n{b}") for a, bs in template.follows.items() for b in bs))
    state = lambda i: F.when(i == 0, F.lit("start")).otherwise(F.element_at("roles", F.when(i == 0, F.lit(1)).otherwise(i)))
    steps = F.transform("roles", lambda r, i: F.when(~F.array_contains(allowed, F.concat(state(i), F.lit("\n"), r)), i))
    bad = F.array_min(steps)
    last = F.element_at("roles", -1)
    ends = F.when(~last.isin(*template.accepting), F.size("roles"))
    return (
        turns_of(rows)
        .select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.flatten(F.transform("turns", pieces)).alias("segments"))
        .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", F.coalesce(bad, ends).alias("first_bad"))
    )


def parse(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns that an output holds: array of role and text, read from the markers alone."""
    begin, middle, end = template.other
    closers = [t.end for t in template.roles.values()] + [end]
    behind = "|".join(_java(c) for c in closers)
    marked = F.filter(F.split(formatted, rf"(?s)(?<={behind})"), lambda x: x != "")

    def read(x: Column) -> Column:
        cut = lambda a, b: F.substring(x, F.lit(len(a) + 1), F.length(x) - F.lit(len(a) + len(b)))
        inner = cut(begin, end)
        at = F.locate(middle, x) - 1 - len(begin)
        role, text = F.substring(inner, F.lit(1), at), F.substring(inner, at + len(middle) + 1, F.length(inner))
        out = None
        for name, t in template.roles.items():
            got = F.struct(F.lit(name).alias("role"), unescape(cut(t.begin, t.end)).alias("text"))
            hit = x.startswith(t.begin) & x.endswith(t.end)
            out = F.when(hit, got) if out is None else out.when(hit, got)
        own = F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
        return own if out is None else out.otherwise(own)

    return F.transform(marked, read)


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What can be read back from formatted chats, as counts and hashes."""
    back = chats.withColumn("_turns", parse(F.col("formatted"), template)).withColumn("_trained", trained_text(F.col("segments")))
    lines = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("_trained").cast("long").alias("loss_chars"), F.sha2(F.col("_trained").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.col("first_bad").cast("long").alias("first_bad"),
    )
