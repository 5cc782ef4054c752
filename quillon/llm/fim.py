"""Fill-in-the-middle rearrangement of texts, on ropes.

A rope is a balanced tree over pieces of a text. A leaf is a span of a string and caches how many lines end in it and how many code points it has; an inner node caches
the sums. A text is cut by splitting its rope at two unit ranks (a unit is a line with its end), the three subtrees are joined in another order with sentinels between
them, and only then written out as a string. The inverse makes a rope of the output, splits it at the code-point ranks of the sentinels and joins the parts back.

Which form a text takes and where it is cut is decided by four numbers made from a hash of its id, so the result doesn't depend on partitions.
Each text is handled by itself, in one map without a shuffle; memory is a few times the longest text.

Defined results: a null text is empty; an empty text, or one that holds a sentinel, stays plain; a null id is hashed as the word null; repeated rows give repeated results;
an empty table gives no rows; only the id and the text are read, columns to keep may have any names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Most code points of a leaf.
LEAF = 4096
_SENTINEL = re.compile("|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))


@dataclass(frozen=True, slots=True)
class Leaf:
    """text[start:end], with the number of line ends in it."""

    text: str
    start: int
    end: int
    ends: int
    depth = 0

    @property
    def chars(self) -> int:
        return self.end - self.start


@dataclass(frozen=True, slots=True)
class Node:
    """Two ropes, one after the other, with their sums."""

    left: Leaf | Node
    right: Leaf | Node
    chars: int
    ends: int
    depth: int


Rope = Leaf | Node
EMPTY = Leaf("", 0, 0, 0)


def _leaf(text: str, start: int, end: int) -> Leaf:
    return Leaf(text, start, end, text.count("\n", start, end))


def rope(text: str) -> Rope:
    """A balanced rope of a text."""
    level: list[Rope] = [_leaf(text, i, min(i + LEAF, len(text))) for i in range(0, len(text), LEAF)] or [EMPTY]
    while len(level) > 1:
        level = [_node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _node(a: Rope, b: Rope) -> Node:
    return Node(a, b, a.chars + b.chars, a.ends + b.ends, 1 + max(a.depth, b.depth))


def join(a: Rope, b: Rope) -> Rope:
    """The concatenation. The shallower rope goes down the side of the deeper one, so the depth stays near that of the deeper."""
    if not a.chars:
        return b
    if not b.chars:
        return a
    if a.depth > b.depth + 1:
        return _node(a.left, join(a.right, b))
    if b.depth > a.depth + 1:
        return _node(join(a, b.left), b.right)
    return _node(a, b)


def split(r: Rope, at: int) -> tuple[Rope, Rope]:
    """The rope cut after so many code points."""
    if at <= 0:
        return EMPTY, r
    if at >= r.chars:
        return r, EMPTY
    if isinstance(r, Leaf):
        return _leaf(r.text, r.start, r.start + at), _leaf(r.text, r.start + at, r.end)
    if at < r.left.chars:
        a, b = split(r.left, at)
        return a, join(b, r.right)
    a, b = split(r.right, at - r.left.chars)
    return join(r.left, a), b


def _last(r: Rope) -> str:
    while isinstance(r, Node):
        r = r.right
    return r.text[r.end - 1 : r.end] if r.chars else ""


def units(r: Rope) -> int:
    """How many lines: ends of lines, and a last line without one."""
    return r.ends + (_last(r) not in ("", "\n"))


def rank(r: Rope, unit: int) -> int:
    """How many code points the first units have; the walk goes down by the cached line ends."""
    if unit <= 0:
        return 0
    if unit > r.ends:
        return r.chars
    before = 0
    while isinstance(r, Node):
        if unit <= r.left.ends:
            r = r.left
        else:
            before, unit, r = before + r.left.chars, unit - r.left.ends, r.right
    at = r.start
    for _ in range(unit):
        at = r.text.index("\n", at, r.end) + 1
    return before + at - r.start


def written(*parts: Rope | str) -> str:
    """The text of ropes and strings, one after the other."""
    out, todo = [], list(reversed(parts))
    while todo:
        r = todo.pop()
        if isinstance(r, Node):
            todo += (r.right, r.left)
        else:
            out.append(r if isinstance(r, str) else r.text[r.start : r.end])
    return "".join(out)


def arrange(text: str, draws: tuple[int, int, int, int], rate: int = 100, spm: int = 50) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None for plain), and the output of a text; rate and spm are percentages."""
    r = rope(text)
    n = units(r)
    if not text or draws[2] % 100 >= rate or _SENTINEL.search(text):
        return n, "plain", None, None, text
    one, two = sorted(x % (n + 1) for x in draws[:2])
    at = rank(r, one)
    prefix, rest = split(r, at)
    middle, suffix = split(rest, rank(r, two) - at)
    if draws[3] % 100 < spm:
        return n, "spm", prefix.chars, middle.chars, written(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    return n, "psm", prefix.chars, middle.chars, written(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)


def restore(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    marks = [(m.group(), m.start()) for m in _SENTINEL.finditer(output)]
    if tuple(s for s, _ in marks) != order or marks[0][1]:
        raise ValueError(f"not an output of form {form}")
    parts, rest = {}, rope(output)
    for name, start in reversed(marks):
        rest, part = split(rest, start)
        parts[name] = split(part, len(name))[1]
    return written(join(join(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def draws(key: str | Column, seed: int = 7) -> Column:
    """Four numbers of 32 bits from the hash of a key."""
    key = F.col(key) if isinstance(key, str) else key
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return F.array(*(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """The columns to keep, n, form, prefix_chars, middle_chars and output of every row."""
    if not (0 <= rate <= 100 and 0 <= spm <= 100):
        raise ValueError("rate and spm are percentages")
    ready = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), draws(key, seed).alias("_draws"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kinds = [f"_k{i} {ready.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    made = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]

    def run(batches):
        for b in batches:
            rows = [arrange(t.as_py(), tuple(d), rate, spm) for d, t in zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1), strict=True)]
            cols = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], [*(f"_k{i}" for i in range(len(keep))), *(n for n, _ in made)])

    done = ready.mapInArrow(run, ", ".join([*kinds, "n long, form string, prefix_chars long, middle_chars long, output string"]))
    return done.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *(n for n, _ in made))


@F.arrow_udf(StringType())
def restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that outputs were made of; null for a null output."""
    return pa.array([None if o is None else restore(o, f) for o, f in zip(output.to_pylist(), form.to_pylist(), strict=True)], pa.string())
