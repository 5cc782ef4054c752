"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A document is its shingles of five words, each weighted by its count times ln(1 + N / df), where N counts distinct texts and df those among them
that have the shingle; no weight is clipped. Texts are dealt into blocks by their hash, so copies meet in one block and count once. A block sends its
distinct shingles, packed by shard; each shard counts its own and sends those of two texts or more back to the blocks that have them, where texts are signed. So
nothing is broadcast, and a task holds one block or one shard.

Improved consistent weighted sampling draws SAMPLES samples (shingle, level) of a document such that two documents share one with the
probability of their weighted Jaccard similarity. Its gamma and uniform variables come from tables of 2 ** 20 states, picked by a hash of
shingle and sample; for the weight of a shingle that stands once in one text the table holds the finished value. BANDS bands of ROWS samples make the buckets: documents of
similarity 0.8 meet with probability 0.998. Pairs are verified by the exact weighted Jaccard similarity of their whole texts, and classes are complete
(see links). In a large group of near copies the shared shingles weigh less than the edited ones. By default (plain) the same is therefore done once more with weight 1
for every distinct shingle, with bands of its own: documents are linked if either similarity reaches 0.8. Equal texts are one item from the start, so a large group of copies costs no comparisons.

Defined results: one row per distinct (id, text): id, content (md5 of the text), class_id, the least id of its class (two texts of one id that aren't alike are two classes of that id, told apart by class_content); a null text
is empty; texts without words are alike only if equal; rows of a null id have a null class; a repeated row counts once; an empty table gives no rows;
extra columns are ignored; names of helper columns start with "_near_".
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import hashing, links
from quillon.llm.common import Scratch, dealt_join, stored

U = np.uint64
K_WORDS = 5
REACH = 0.8
SAMPLES, ROWS = 48, 4
BANDS = SAMPLES // ROWS
STATES = 20
#: Bits of a shingle within its shard.
BITS = 40
#: Documents of a shard and of a block, on average.
DOCS_PER_SHARD, DOCS_PER_BLOCK = 2000, 2000
#: Texts that a task keeps in mind so as to send them once.
SEEN = 2_000_000
#: Items that are broadcast at most; more are joined by a shuffle.
BROADCAST = 1_000_000


def _packed(keys: np.ndarray) -> bytes:
    """The low 40 bits of each key."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, : BITS // 8].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // (BITS // 8), 8), np.uint8)
    out[:, : BITS // 8] = np.frombuffer(blob, np.uint8).reshape(-1, BITS // 8)
    return out.view(U).ravel()


def rows_of(texts: pa.Array):
    """For each chunk of a column: first row, last row, and the distinct shingles (row, hash, times)."""
    data, offsets = hashing.buffers(texts)
    for lo, hi in hashing.chunks(data, offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        row, words = hashing.word_hashes(part, at)
        yield lo, hi, *hashing.shingles(row, words, hi - lo, K_WORDS)


def _once(batches):
    """Texts, each once in a task (or in SEEN texts)."""
    seen = set()
    for b in batches:
        new = []
        for i, text in enumerate(b.column(0)):
            own = hashlib.md5(text.as_buffer()).digest()
            if own not in seen:
                seen.add(own)
                new.append(i)
        if len(seen) > SEEN:
            seen.clear()
        yield b.take(pa.array(new, pa.int64()))


def in_blocks(rows: DataFrame, n: int) -> DataFrame:
    """(block, text) of n rows: copies of a text are in one block, at most one from each task."""
    texts = rows.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_once, "text string")
    return texts.select(F.pmod(F.xxhash64("text"), F.lit(max(12, math.ceil(n / DOCS_PER_BLOCK)))).cast("int").alias("block"), "text")


def _sender(shard_bits: int):
    """Of a block: its distinct shingles by shard, those of one text and of more."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, U), *(k for *_, k, _ in rows_of(table.column("text").combine_chunks().unique()))])
        keys, times = np.unique(keys, return_counts=True)
        cut = np.searchsorted(keys, np.arange(1, 1 << shard_bits, dtype=U) << U(64 - shard_bits))
        low = keys >> U(64 - shard_bits - BITS)
        out = []
        for s, (a, b) in enumerate(zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True)):
            if a < b:
                one = times[a:b] == 1
                out.append((s, _packed(low[a:b][one]), _packed(low[a:b][~one]), times[a:b][~one].astype(np.uint32).tobytes()))
        block = np.full(len(out), table.column("block")[0].as_py(), np.int32)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({"block": block} | {c: pa.array([o[i] for o in out], k) for i, (c, k) in enumerate(zip(("shard", "once", "often", "counts"), kinds, strict=True))})

    return run


def _counter(table: pa.Table) -> pa.Table:
    """Of a shard: for each block, its shingles (their top bits) that two texts or more have, and in how many texts of all they are."""
    shard = table.column("shard")[0].as_py()
    once, often = ([_unpacked(x) for x in table.column(c).to_pylist()] for c in ("once", "often"))
    times = [np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("counts").to_pylist()]
    keys = np.concatenate(once + often)
    at = np.repeat(np.tile(np.arange(len(once)), 2), [len(x) for x in once + often])
    times = np.concatenate([np.ones(sum(map(len, once)), np.int64), *times])
    order = np.argsort(keys, kind="stable")
    keys, at, times = keys[order], at[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    df = np.repeat(np.add.reduceat(times, first), np.diff(np.append(first, len(keys))))
    keep = np.flatnonzero(df >= 2)
    keep = keep[np.argsort(at[keep], kind="stable")]
    keys, at, df = keys[keep] | (U(shard) << U(BITS)), at[keep], df[keep].astype(np.uint32)
    own = np.unique(at)
    cut = list(zip(np.searchsorted(at, own).tolist(), np.searchsorted(at, own, "right").tolist(), strict=True))
    block = table.column("block").to_numpy()[own]
    return pa.table({"block": pa.array(block, pa.int32()), "keys": pa.array([keys[a:b].tobytes() for a, b in cut], pa.binary()), "df": pa.array([df[a:b].tobytes() for a, b in cut], pa.binary())})


def _shard_bits(n: int) -> int:
    return min(20, max(6, math.ceil(math.log2(max(1, n / DOCS_PER_SHARD)))))


def frequencies(blocks: DataFrame, shard_bits: int) -> DataFrame:
    """(block, keys, df) of texts in blocks: the shingles of each block that two distinct texts or more have, of all texts."""
    sent = blocks.groupBy("block").applyInArrow(_sender(shard_bits), "block int, shard int, once binary, often binary, counts binary")
    return sent.groupBy("shard").applyInArrow(_counter, "block int, keys binary, df binary")


def idf(n: int, df: np.ndarray) -> np.ndarray:
    """The weight of shingles that df of n distinct texts have."""
    return np.log1p(n / df)


class Weights:
    """IDF of shingles: a sorted table of those that two texts or more have; all others are in one text."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, n: int, shard_bits: int) -> None:
        order = np.argsort(keys)
        self.keys, self.df, self.n, self.shift = keys[order], df[order], n, 64 - shard_bits - BITS
        self.idf = idf(n, self.df)
        self.common = float(idf(n, np.ones(1, np.uint32))[0])

    @classmethod
    def of(cls, table: pa.Table, n: int, shard_bits: int) -> Weights:
        """Of rows of frequencies."""
        keys, df = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("keys", U), ("df", np.uint32)))
        keys, first = np.unique(keys, return_index=True)
        return cls(keys, df[first], n, shard_bits)

    def frequency(self, hashes: np.ndarray) -> np.ndarray:
        """In how many texts each shingle is."""
        df = np.ones(len(hashes), np.uint32)
        if len(self.keys) and len(hashes):
            top = hashes >> U(self.shift)
            at = np.minimum(np.searchsorted(self.keys, top), len(self.keys) - 1)
            hit = self.keys[at] == top
            df[hit] = self.df[at[hit]]
        return df

    def __call__(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The weights of shingles that stand so many times."""
        return idf(self.n, self.frequency(hashes)) * times


def weights(texts: DataFrame) -> Weights:
    """The weights of all shingles of a column text in one table, for samples and checks: it goes through the driver. classes leaves them in blocks."""
    n = texts.count()
    found = frequencies(in_blocks(texts, n), _shard_bits(n)).toArrow()
    return Weights.of(found, max(1, texts.select("text").distinct().count()), _shard_bits(n))


@lru_cache(maxsize=1)
def _states(seed: int) -> np.ndarray:
    """r, ln c and b of every state, once in a worker."""
    g = np.random.Generator(np.random.PCG64(seed))
    size = 1 << STATES
    out = np.empty((size, 3), np.float32)
    for x in np.split(out, 16):  # in parts: a worker keeps what it once took
        x[:, 0], x[:, 1], x[:, 2] = g.gamma(2.0, 1.0, len(x)), np.log(g.gamma(2.0, 1.0, len(x))), g.random(len(x))
    return out


class Sampler:
    """Improved consistent weighted sampling, with a table of the finished values of a common weight."""

    def __init__(self, common: float, seed: int = 11) -> None:
        self.states = _states(seed)
        self.odd = np.random.Generator(np.random.PCG64(seed + 1)).integers(0, 1 << 63, SAMPLES, dtype=U) * U(2) + U(1)
        self.common = common
        self.table = np.empty(1 << STATES, U)
        part = 1 << STATES - 4
        for lo in range(0, 1 << STATES, part):
            self.table[lo : lo + part] = self.values(np.full(part, math.log(common)), np.arange(lo, lo + part))

    def values(self, ln_w: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The sampling value in the upper half, the level mixed in the lower half."""
        r, ln_c, b = self.states.take(state, 0).T
        level = np.floor(ln_w.astype(np.float32) / r + b)
        a = np.exp(np.clip(ln_c - r * (level - b) - r, -80, 80))
        low = hashing.mix(level.astype(np.int64).view(U)) & U(0xFFFFFFFF)
        return (a.view(np.uint32).astype(U) << U(32)) | low

    def samples(self, row: np.ndarray, keys: np.ndarray, w: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have shingles, and their samples [row, SAMPLES]."""
        have, first = np.unique(row, return_index=True)
        out = np.empty((len(have), SAMPLES), U)
        if not len(have):
            return have, out
        low = keys & U(0xFFFFFFFF)
        own = np.flatnonzero(w != self.common)
        ln_w = np.log(w[own])
        for k in range(SAMPLES):
            state = ((keys * self.odd[k]) >> U(64 - STATES)).view(np.int64)
            v = self.table.take(state)
            if len(own):
                v[own] = self.values(ln_w, state[own])
            v ^= low
            out[:, k] = np.minimum.reduceat(v, first)
        return have, out


@lru_cache(maxsize=2)
def _sampler(common: float) -> Sampler:
    """One for each worker."""
    return Sampler(common)


def _band_keys(s: np.ndarray, first: int) -> np.ndarray:
    """The keys [row, BANDS] of samples; bands are numbered from first."""
    grouped = hashing.mix(s).reshape(len(s), BANDS, ROWS)
    key = np.zeros((len(s), BANDS), U)
    for j in range(ROWS):
        key = key * hashing.FOLD + grouped[:, :, j]
    return hashing.mix(key + np.arange(first, first + BANDS, dtype=U) * hashing.BASE).view(np.int64)


def _signer(n: int, shard_bits: int):
    """Of a block's texts and its frequencies: content, bands and the frequencies of the text's shingles, in the order of their hashes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("text").combine_chunks().unique()
        weigh = Weights.of(right, n, shard_bits)
        sampler, plain = _sampler(weigh.common), _sampler(1.0)
        data, offsets = hashing.buffers(texts)
        raw = data.tobytes()
        content = [hashlib.md5(raw[x:y]).hexdigest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        bands: list = [None] * len(texts)
        found: list = [b""] * len(texts)
        for lo, hi, row, keys, times in rows_of(texts):
            df = weigh.frequency(keys)
            have, s = sampler.samples(row, keys, idf(n, df) * times, hi - lo)
            key = np.concatenate((_band_keys(s, 0), _band_keys(plain.samples(row, keys, np.ones(len(keys)), hi - lo)[1], BANDS)), 1)
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            for k, i in enumerate(have.tolist()):
                bands[lo + i] = key[k]
                found[lo + i] = df[cut[i] : cut[i + 1]].tobytes()
        return pa.table({"content": pa.array(content, pa.string()), "bands": pa.array(bands, pa.list_(pa.int64())), "df": pa.array(found, pa.binary())})

    return run


def signed(rows: DataFrame, n_rows: int, n: int) -> DataFrame:
    """content, bands (null without words) and df of the n distinct texts of rows: BANDS by weights, then BANDS by plain sets."""
    blocks, shard_bits = in_blocks(rows, n_rows), _shard_bits(n_rows)
    return blocks.groupBy("block").cogroup(frequencies(blocks, shard_bits).groupBy("block")).applyInArrow(_signer(n, shard_bits), "content string, bands array<long>, df binary")


def similarity(keys_a, w_a, keys_b, w_b) -> float:
    """Weighted Jaccard similarity of two sorted shingle sets."""
    both, i, j = np.intersect1d(keys_a, keys_b, assume_unique=True, return_indices=True)
    x, y = w_a[i], w_b[j]
    over = np.minimum(x, y).sum()
    under = w_a.sum() + w_b.sum() - over
    return float(over / under) if under > 0 else 0.0


def _by_idf(n: int):
    """The weighted shingles of bodies (text, df), by chunks: first row, last row, row, hash, weight."""

    def run(bodies: pa.StructArray):
        df = bodies.field("df")
        for lo, hi, row, keys, times in rows_of(bodies.field("text")):
            yield lo, hi, row, keys, idf(n, np.frombuffer(b"".join(df.slice(lo, hi - lo).to_pylist()), np.uint32)) * times

    return run


def _alike(bodies: pa.StructArray):
    """The same with weight 1 for every distinct shingle: the similarity is that of the plain sets."""
    for lo, hi, row, keys, _ in rows_of(bodies.field("text")):
        yield lo, hi, row, keys, np.ones(len(keys))


def _features(weighed):
    """The weighted shingles of a column of bodies: row, hash, weight."""

    def run(bodies: pa.Array):
        parts = [(lo + row, keys, w) for lo, _, row, keys, w in weighed(bodies)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0))

    return run


def _verifier(weighed):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = []
                for c in (2, 3):
                    found = []
                    for lo, hi, row, keys, w in weighed(part.column(c)):
                        cut = np.searchsorted(row, np.arange(hi - lo + 1))
                        found += [(keys[x:y], w[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    sets.append(found)
                got = [similarity(*x, *y) for x, y in zip(*sets, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.float64())], ["a", "b", "similarity"])

    return run


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: float = REACH, plain: bool = True) -> DataFrame:
    """id, content, class_id and class_content of every distinct (id, text): the last two are the least id of its class and the least text (md5) of that id in it.

    plain: whether documents are linked by the similarity of their plain sets, too, or only by weights.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.keep(_classes(docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), reach, plain))


def _classes(rows: DataFrame, reach: float, plain: bool) -> DataFrame:
    marked = stored(rows.select("id", F.md5("text").alias("content")).distinct())
    signs = signed(rows, rows.count(), max(1, n := marked.select("content").distinct().count()))
    known = marked.where("id IS NOT NULL")
    copies = known.groupBy("content").agg(F.min("id").alias("item"), F.count("*").alias("copies"))
    texts = stored(copies.join(signs, "content"))
    # equal ids may carry several texts: an item is a text, and is named by a number that orders as its least id does
    named = texts.select("item", "content", "bands", "df", "copies")
    twice = named.groupBy("item").agg(F.count("*").alias("n")).where("n > 1")
    item = "item"
    if not twice.isEmpty():
        raise_to = named.join(twice.select("item", F.lit(True).alias("shared_id")), "item", "left")
        # texts of one id: negative numbers, so that they are told apart; below, roots are mapped back to the least id
        named = stored(raise_to.withColumn("item2", F.when(F.col("shared_id"), -F.abs(F.xxhash64("content")) - 1).otherwise(F.col("item"))))
        item = "item2"
    all_bands = named.where("bands IS NOT NULL").select(F.posexplode("bands").alias("band", "bucket"), F.col(item).alias("id"))
    all_bands = all_bands if plain else all_bands.where(f"band < {BANDS}")
    crowded = stored(all_bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    members = stored(dealt_join(all_bands, crowded, ["bucket"], "n").drop("n"))
    wanted = named.select(F.col(item).alias("wanted"), F.col("item").alias("own"), "content", "df").join(members.select(F.col("id").alias("wanted")).distinct(), "wanted")
    wanted = stored(wanted)
    small = F.broadcast if wanted.count() <= BROADCAST else (lambda x: x)
    mine = rows.join(small(wanted.select("own").distinct()), F.col("id") == F.col("own"), "left_semi").select(F.col("id").alias("own"), F.md5("text").alias("content"), "text")
    bodies = stored(mine.join(wanted, ["own", "content"]).select(F.col("wanted").alias("id"), F.struct("text", "df").alias("body")).dropDuplicates(["id"]))

    def rooted(weighed, bands: str) -> DataFrame:
        return links.linked(members.where(bands).select("bucket", "id"), bodies, _verifier(weighed), _features(weighed), reach)

    found = rooted(_by_idf(max(1, n)), f"band < {BANDS}")
    if plain:
        found = found.unionByName(rooted(_alike, f"band >= {BANDS}"))
    roots = links.components(found)
    placed = named.select(F.col(item).alias("own"), F.col("item").alias("first"), F.col("content").alias("text_md5"), "copies").join(roots.withColumnRenamed("id", "own"), "own", "left").withColumn("root", F.coalesce("root", "own"))
    placed = stored(placed)
    least = placed.groupBy("root").agg(F.min(F.struct("first", "text_md5")).alias("least"), F.count("*").alias("n"))
    by_content = stored(dealt_join(placed, stored(least), ["root"], "n").select(F.col("text_md5").alias("content"), F.col("least.first").alias("class_id"), F.col("least.text_md5").alias("class_content"), "copies"))
    done = dealt_join(known, by_content, ["content"], "copies").select("id", "content", "class_id", "class_content")
    return done.unionByName(marked.where("id IS NULL").select("id", "content", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("string").alias("class_content")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: float = REACH) -> DataFrame:
    """The rows of docs that stay: of each class, the row of the least id (and of its least md5); all columns as they were. Rows of a null id stay."""
    with Scratch(docs.sparkSession) as scratch:
        found = classes(docs, key, text, reach).where("id IS NOT NULL")
        once = found.count()
        # the least id of a class may have several texts in it, and texts in several classes
        gone = scratch.keep(found.where("id <> class_id OR content <> class_content").select(F.col("id").alias("_near_gone"), F.col("content").alias("_near_gone_text")))
    small = F.broadcast if gone.count() <= BROADCAST else (lambda x: x)
    marked = docs.withColumn("_near_text", F.md5(F.coalesce(F.col(text), F.lit(""))))
    left = marked.join(small(gone), (F.col(key) == F.col("_near_gone")) & (F.col("_near_text") == F.col("_near_gone_text")), "left_anti")
    if docs.where(F.col(key).isNotNull()).count() == once:  # no row stands twice
        return left.drop("_near_text")
    whole = left.where(F.col(key).isNotNull()).dropDuplicates([key, "_near_text"]).unionByName(left.where(F.col(key).isNull()))
    return whole.drop("_near_text")
