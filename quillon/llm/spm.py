"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is marked (a leading space, every space written as the mark) and cut where no piece can reach across: before a mark that follows
another character, and around characters that aren't in the vocabulary. The distinct marked words of a batch are sorted, which
lays them out as a trie in depth-first order; the forward state of every prefix is computed once and is reused by all words that share it.
Cutting, joining of ids and decoding are array operations on the bytes of a batch. Words are told apart by 64-bit hashes there, so every text is
decoded from its ids and compared; one that differs is encoded word by word.

For a unigram model the state of a prefix is the best score and its last piece. For a BPE model, whose encoding isn't the best-scoring
path, the state is the last piece of the prefix's own encoding: a piece ends the encoding of a prefix exactly if, with the last
piece of what is before it, it is left as it is when the two are encoded together. So the same pass gives the ids that merging gives.

Characters outside the vocabulary become byte pieces. Encoding is reversible: a literal mark in a text is written as bytes, so decoding
gives the text back exactly, and the leading space that encoding adds is taken off again.

Defined results: a null text has null ids (and decodes to null); an empty text has no ids; very long texts are encoded whole; repeated rows give
repeated results; an empty table gives no rows; only the columns asked for and the text are read. Encoding is one map over the texts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import hashing

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a literal mark among the words of a text; no word is written so.
LITERAL = "\0" + MARK
#: Words that a worker keeps with their ids.
CACHE = 700_000
#: Decisions on pairs of pieces that a worker keeps.
PAIRS = 2_000_000
#: Longest run of characters, in bytes, that is kept in the cache.
KEPT = 64
#: Bytes of text that are encoded together; the arrays of the pass take many times as much, and a worker keeps what it once took.
CHUNK = 1 << 20
#: Sets the first word of a text, which gets a mark of its own, apart from the same bytes elsewhere.
FIRST = np.uint64(0xA24BAED4963EE407)
#: Kinds of characters: spaces, characters of the vocabulary, others, literal marks.
SPACE, KNOWN, OTHER, WRITTEN = range(4)


@dataclass
class Model:
    """Pieces with scores. kind: "bpe" or "unigram"; byte_ids: the id of each byte's piece, or empty; unknown: the id used without byte pieces."""

    pieces: list[str]
    scores: list[float]
    kind: str
    byte_ids: list[int]
    usable: list[bool]
    unknown: int = 0
    prefix: bool = True
    ids: dict[str, int] = field(default_factory=dict)
    ready: Encoder | None = None

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, ok) in enumerate(zip(self.pieces, self.usable, strict=True)) if ok}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"ready": None}

    def encoder(self) -> Encoder:
        """The encoder of this process, with the words that it keeps."""
        if self.ready is None:
            self.ready = Encoder(self)
        return self.ready


def load(path: str = VOCABULARY) -> Model:
    """Read a model file on the driver."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models that leave texts as they are can be decoded exactly")
    at = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 6}
    byte_ids = [at[f"<0x{b:02X}>"] for b in range(256)] if at else []
    unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
    return Model([p.piece for p in m.pieces], [p.score for p in m.pieces], {1: "unigram", 2: "bpe"}[m.trainer_spec.model_type], byte_ids, [p.type == 1 for p in m.pieces], unknown, m.normalizer_spec.add_dummy_prefix)


def merged(symbols: str, model: Model) -> list[str]:
    """BPE by merging: the adjacent pair whose union is the piece of highest score, leftmost first. Only used on a pair of pieces."""
    parts, ids, scores = list(symbols), model.ids, model.scores
    score = lambda a, b: -math.inf if (k := ids.get(a + b)) is None else scores[k]
    pairs = list(map(score, parts, parts[1:]))
    while pairs and (best := max(pairs)) > -math.inf:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = score(parts[i - 1], parts[i])
        if i < len(pairs):
            pairs[i] = score(parts[i], parts[i + 1])
    return parts


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start : start + size] of many spans, one after another."""
    end = np.cumsum(size)
    at = np.repeat(start - (end - size), size)
    at += np.arange(len(at))
    return data[at]


class Decoder:
    """Decodes many texts at once: the bytes of all pieces are one array, from which spans are gathered."""

    def __init__(self, model: Model) -> None:
        table = [p.replace(MARK, " ").encode() if ok else b"" for p, ok in zip(model.pieces, model.usable, strict=True)]
        for b, i in enumerate(model.byte_ids):
            table[i] = bytes([b])
        self.size = np.array([len(p) for p in table], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(table) + b"\0", np.uint8)
        self.prefix = model.prefix

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts, and their offsets. The space that encoding puts before a text is taken off."""
        start, size = self.start[ids], self.size[ids]
        if self.prefix:
            first = offsets[:-1][offsets[:-1] < offsets[1:]]
            spaced = first[(size[first] > 0) & (self.data[start[first]] == 32)]
            start[spaced] += 1
            size[spaced] -= 1
        ends = np.concatenate(([0], np.cumsum(size)))
        return gathered(self.data, start, size), ends[offsets]


class Encoder:
    """Encodes words and texts; keeps words and pair decisions within bounds."""

    def __init__(self, model: Model) -> None:
        self.model, self.decoder = model, Decoder(model)
        self.alphabet = {p for p in model.ids if len(p) == 1}
        # a trie of the pieces; the state of a prefix is its longest end that begins a piece, and has all pieces that end there
        self.step: list[dict[str, int]] = [{}]
        self.fallback, self.ending, own = [0], [()], [None]
        for p, i in model.ids.items():
            if model.kind == "bpe" and len(p) > 1 and merged(p, model) != [p]:
                continue  # never comes out of merging
            s = 0
            for c in p:
                if c not in self.step[s]:
                    self.step[s][c] = len(self.step)
                    self.step.append({})
                    own.append(None)
                s = self.step[s][c]
            own[s] = (i, len(p))
        self.fallback, self.ending = [0] * len(own), [()] * len(own)
        level = list(self.step[0].values())
        for s in level:
            self.ending[s] = (own[s],) if own[s] else ()
        edges = [dict(x) for x in self.step]
        while level:
            for s in level:
                for c, t in edges[s].items():
                    f = self.fallback[s]
                    while f and c not in edges[f]:
                        f = self.fallback[f]
                    self.fallback[t] = f = edges[f].get(c, 0)
                    self.ending[t] = ((own[t],) if own[t] else ()) + self.ending[f]
            level = [t for s in level for t in edges[s].values()]
        self.pairs: list[dict[int, bool]] = [{} for _ in model.pieces]
        self.n_pairs = 0
        known = "".join(re.escape(c) for c in sorted(self.alphabet - {MARK}))
        self._words = re.compile(f"{MARK}*[{known}]+|{MARK}+|[^{known}{MARK}]+" if known else f"{MARK}+|[^{MARK}]+")
        self.kinds = np.full(0x110000, OTHER, np.uint8)
        self.kinds[[ord(c) for c in self.alphabet]] = KNOWN
        self.kinds[32], self.kinds[ord(MARK)] = SPACE, WRITTEN
        self._forget()

    def _forget(self) -> None:
        """An empty cache: slots by the hash of a word; the ids of all slots in one array."""
        self.slots: dict[int, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._overfull = False

    def _stays(self, a: int, b: int) -> bool:
        """Whether two pieces stay as they are when encoded together."""
        if self.n_pairs > PAIRS:
            self.pairs, self.n_pairs = [{} for _ in self.model.pieces], 0
        x, y = self.model.pieces[a], self.model.pieces[b]
        self.n_pairs += 1
        got = self.pairs[a][b] = merged(x + y, self.model) == [x, y]
        return got

    def _next(self, s: int, c: str) -> int:
        """The state after one more character; remembered."""
        f = s
        while f and c not in self.step[f]:
            f = self.fallback[f]
        self.step[s][c] = got = self.step[f].get(c, 0)
        return got

    def learn(self, words: set[str]) -> dict[str, list[int]]:
        """The ids of distinct marked words. In sorted order, each shares the states of the prefix it has in common with the one before.

        Runs of characters outside the vocabulary stand among them and get the ids of their bytes.
        """
        step, ending, alphabet, scores, bpe = self.step, self.ending, self.alphabet, self.model.scores, self.model.kind == "bpe"
        found: dict[str, list[int]] = {}
        # of every prefix: its state in the trie, the last piece and its length, and (unigram) the best score
        before, states, last, best = "", [0], [(-1, 0)], [0.0]
        for word in sorted(words):
            if word[-1] not in alphabet or word == LITERAL:
                found[word] = self._bytes(MARK if word == LITERAL else word)
                continue
            same = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                same += 1
            del states[same + 1 :], last[same + 1 :], best[same + 1 :]
            s, end = states[same], same
            for c in word[same:]:
                end += 1
                t = step[s].get(c)
                s = self._next(s, c) if t is None else t
                if bpe:
                    for piece in ending[s]:
                        i, n = piece
                        if n == end:
                            break
                        prior = last[end - n][0]
                        stays = self.pairs[prior].get(i)
                        if stays or stays is None and self._stays(prior, i):
                            break
                else:
                    top = -math.inf
                    for choice in ending[s]:
                        if (score := best[end - choice[1]] + scores[choice[0]]) > top:
                            top, piece = score, choice
                    best.append(top)
                states.append(s)
                last.append(piece)
            out = []
            while end:
                i, n = last[end]
                out.append(i)
                end -= n
            out.reverse()
            found[word] = out
            before = word
        return found

    def split(self, text: str) -> list[str]:
        """Marked words and, between them, runs of characters outside the vocabulary. A literal mark in the text becomes LITERAL."""
        if not text:
            return []
        if MARK not in text:
            return self._words.findall((MARK if self.model.prefix else "") + text.replace(" ", MARK))
        out: list[str] = []
        for i, part in enumerate(text.split(MARK)):
            if i:
                out.append(LITERAL)
            out += self._words.findall((MARK if i == 0 and self.model.prefix else "") + part.replace(" ", MARK))
        return out

    def _bytes(self, text: str) -> list[int]:
        if not self.model.byte_ids:
            return [self.model.unknown] * len(text)
        return [self.model.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")]

    def _kinds_of(self, raw: np.ndarray) -> np.ndarray:
        """The kind of the character that each byte of some UTF-8 text belongs to."""
        kinds = self.kinds[:256][raw]
        lead = np.flatnonzero(raw >= 0xC0)
        if len(lead):
            first = raw[lead].astype(np.int64)
            more = 1 + (first >= 0xE0) + (first >= 0xF0)
            code = first & (0x3F >> more)
            for j in (1, 2, 3):
                has = more >= j
                code[has] = code[has] << 6 | raw[lead[has] + j] & 0x3F
            own = self.kinds[code]
            kinds[lead] = own
            for j in (1, 2, 3):
                kinds[lead[more >= j] + j] = own[more >= j]
        return kinds

    def _cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts: first byte and hash of every word, which of them begin a text, and the rows with a literal mark."""
        kinds = self._kinds_of(raw)
        space, other = kinds == SPACE, kinds == OTHER
        new = np.zeros(len(raw), bool)
        new[1:] = (space[1:] & ~space[:-1]) | (other[1:] != other[:-1])
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        new[begins] = True
        start = np.flatnonzero(new)
        h = hashing.mix(hashing.spans(raw.astype(np.uint16) + np.uint16(1), start, np.append(start[1:], len(raw))))
        leading = np.searchsorted(start, begins)
        if self.model.prefix:
            h[leading] ^= FIRST
        return start, h, leading, np.unique(np.searchsorted(offsets, np.flatnonzero(kinds == WRITTEN), "right") - 1)

    def _slots_of(self, raw: np.ndarray, start: np.ndarray, hashes: np.ndarray, leading: np.ndarray) -> np.ndarray:
        """The cache slot of every word; words that aren't there are learned together, in sorted order."""
        coded = pa.array(hashes.view(np.int64)).dictionary_encode()
        codes, keys = coded.indices.to_numpy(), coded.dictionary.to_numpy().tolist()
        slots = np.array([-1 if x is None else x for x in map(self.slots.get, keys)], np.int64)
        if (slots < 0).any() and len(self.slots) > CACHE:
            self._forget()
            slots[:] = -1
        lacking = np.flatnonzero(slots < 0)
        if len(lacking):
            first = np.empty(len(keys), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            place = first[lacking]
            marked = np.isin(place, leading) if self.model.prefix else np.zeros(len(place), bool)
            ends = np.append(start[1:], len(raw))
            parts = [self._words.findall(MARK * m + raw[a:b].tobytes().decode().replace(" ", MARK)) for a, b, m in zip(start[place].tolist(), ends[place].tolist(), marked.tolist(), strict=True)]
            found = self.learn({w for ws in parts for w in ws})
            ids = [[i for w in ws for i in found[w]] for ws in parts]
            size = np.array([len(x) for x in ids], np.int64)
            slots[lacking] = np.arange(len(self.size), len(self.size) + len(size))
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.flat = np.concatenate((self.flat, np.array([i for x in ids for i in x], np.int32)))
            short = ends[place] - start[place] <= KEPT
            self.slots.update(zip(coded.dictionary.to_numpy()[lacking[short]].tolist(), slots[lacking[short]].tolist(), strict=True))
            self._overfull = len(self.flat) > 8 * CACHE
        return slots[codes]

    def encoded(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of UTF-8 texts: ids, their offsets, what the ids decode to, and its offsets.

        Words are told apart by hashes; every text is decoded and compared, and one that differs (or holds a literal mark) is encoded word by word.
        """
        if self._overfull:
            self._forget()
        start, h, leading, odd = self._cut(raw, offsets)
        slots = self._slots_of(raw, start, h, leading)
        size = self.size[slots]
        ids = gathered(self.flat, self.start[slots], size)
        at = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, offsets)]
        back, back_at = self.decoder.decoded(ids, at)
        if not len(odd) and np.array_equal(back_at, offsets) and np.array_equal(back, raw):
            return ids, at, back, back_at
        rows = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        wrong = set(odd.tolist()) | {i for i in range(len(rows)) if not np.array_equal(back[back_at[i] : back_at[i + 1]], raw[offsets[i] : offsets[i + 1]])}
        for i in wrong:
            ws = self.split(raw[offsets[i] : offsets[i + 1]].tobytes().decode())
            found = self.learn(set(ws))
            rows[i] = np.array([k for w in ws for k in found[w]], np.int32)
        ids, at = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        return ids, at, *self.decoder.decoded(ids, at)

    def arrow(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Columns of a column of texts: their ids, and what those decode to; nulls stay nulls."""
        raw, offsets = hashing.buffers(texts)
        ids, ends, back, back_ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
        for lo, hi in hashing.chunks(raw, offsets, CHUNK):
            a, b, c, d = self.encoded(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            ids.append(a)
            ends.append(b[1:] + ends[-1][-1])
            back.append(c)
            back_ends.append(d[1:] + back_ends[-1][-1])
        null = np.append(texts.is_null().to_numpy(zero_copy_only=False), False)
        at = pa.array(np.concatenate(ends).astype(np.int32), mask=null) if null.any() else pa.array(np.concatenate(ends).astype(np.int32))
        return pa.ListArray.from_arrays(at, pa.array(np.concatenate(ids))), strings(np.concatenate(back), np.concatenate(back_ends), null[:-1])

    def encode_batch(self, texts: list[str | None]) -> list[list[int] | None]:
        """The ids of some texts."""
        return self.arrow(pa.array(texts, pa.string()))[0].to_pylist()

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of some ids."""
        return None if ids is None else self.decoder.decoded(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode()


def strings(data: np.ndarray, ends: np.ndarray, null: np.ndarray) -> pa.Array:
    """A column of texts from their bytes and offsets."""
    mask = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()) if null.any() else None
    return pa.Array.from_buffers(pa.large_binary(), len(null), [mask, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def _named(docs: DataFrame, keep: tuple[str, ...], last: str) -> tuple[DataFrame, str]:
    """The columns to keep under names of our own, then another column; and the types of the former."""
    ready = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(last).alias("_last"))
    return ready, "".join(f"_k{i} {ready.schema[f'_k{i}'].dataType.simpleString()}, " for i in range(len(keep)))


def encode(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", check: bool = False) -> DataFrame:
    """The columns to keep and ids of every text; with check, also decoded: what the ids decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ready, kinds = _named(docs, keep, text)

    def run(batches):
        encoder = shared.value.encoder()
        for b in batches:
            sizes = hashing.buffers(b.column(len(keep)))[1]
            for lo, hi in hashing.chunks(sizes, sizes, 8 << 20):
                part = b.slice(lo, hi - lo)
                found = encoder.arrow(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *found[: 1 + check]], [*(f"_k{i}" for i in range(len(keep))), "ids", "decoded"][: len(keep) + 1 + check])

    done = ready.mapInArrow(run, f"{kinds}ids array<int>" + ", decoded string" * check)
    return done.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "ids", *["decoded"] * check)


def decode(rows: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The columns to keep and the decoded text of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    ready, kinds = _named(rows, keep, ids)

    def run(batches):
        decoder = Decoder(shared.value)
        for b in batches:
            lists = b.column(len(keep))
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            data, ends = decoder.decoded(lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(size))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), strings(data, ends, lists.is_null().to_numpy(zero_copy_only=False))], [*(f"_k{i}" for i in range(len(keep))), "text"])

    done = ready.mapInArrow(run, f"{kinds}text string")
    return done.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "text")
