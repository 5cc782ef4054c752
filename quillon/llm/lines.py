"""Fuzzy line dedup: MinHash signatures of character shingles, banding, exact Jaccard verification, distributed union-find; one line of each component stays.

A line is compared as its lower-case characters with white space run together, by the set of its shingles of SHINGLE characters. One hash for each shingle is
dealt into BANDS x ROWS bins, the least of a bin is its value, and empty bins take over the next filled one. Lines of Jaccard similarity REACH
share a band with probability 0.99. Bands are packed and counted by shard, so only buckets with two different lines become rows.
Candidates are verified on the exact shingle sets and classes are complete (see links). Of all lines of a component, over all documents,
the one at the least position (document id, text hash, line number) stays; all others go.

Defined results: a null text stays null, an empty one empty; blank lines always stay, all others are compared, however short; a document
keeps its row even if no line is left (its text is then empty); repeated rows of one id and text are one document and fare alike; null ids
come first; an empty table gives no rows; all columns come back, the text replaced; names of helper columns start with "_line_".
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import hashing, links
from quillon.llm.common import Scratch, dealt_join, stored

U = np.uint64
#: Characters of a shingle, a power of two.
SHINGLE = 8
REACH = 0.8
BANDS, ROWS = 12, 5
BINS = BANDS * ROWS
#: Pairs (band key, line) that a task holds before it sends them.
FLUSH = 6_000_000
DOCS_PER_SHARD = 2000
#: Lines that a task keeps in mind so as to send them once.
SEEN = 2_000_000
#: Rows that are broadcast at most; more are joined by a shuffle.
BROADCAST = 500_000
#: Characters that are hashed together.
CHUNK = 1 << 17


def normal(line: str) -> str:
    """The form in which lines are compared."""
    low = line.lower()
    # no white space but single spaces inside: nothing to run together (a printable character is no white space, but for the space)
    if "  " not in low and low.isprintable() and low[:1] != " " and low[-1:] != " ":
        return low
    return " ".join(low.split())


def name(line: str) -> bytes:
    """The identity of a line: 16 bytes of its hash; the first 8 are its number among candidates."""
    return hashlib.md5(line.encode("utf-8", "surrogatepass")).digest()


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles of some normal lines; a shorter line is one shingle."""
    size = np.array([len(x) for x in lines], np.int64)
    gap = SHINGLE - 1
    text = np.frombuffer(("\0" * gap).join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(1)
    after = np.cumsum(size + gap) - gap
    text[(after[:, None] + np.arange(gap)).ravel()] = 0  # a line that is shorter than a shingle is filled with zeros
    # windows of 1, 2, 4 .. symbols make those of SHINGLE
    h, step = text, 1
    while step < SHINGLE:
        h, step = h[:-step] * U(pow(int(hashing.BASE), step, 1 << 64)) + h[step:], 2 * step
    count = np.where(size > 0, np.maximum(size - gap, 1), 0)
    row = np.repeat(np.arange(len(lines)), count)
    start = np.arange(count.sum()) + np.repeat(after - size - (np.cumsum(count) - count), count)
    return row, hashing.mix(h[start])


def bands(lines: list[str]) -> np.ndarray:
    """The band keys [line, BANDS] of normal, non-empty lines."""
    row, h = shingles(lines)
    n = len(lines)
    least = np.full(n * BINS, 0xFFFFFFFF, np.uint32)
    bin_ = ((h >> U(32)) * U(BINS)) >> U(32)
    np.minimum.at(least, row * BINS + bin_.astype(np.int64), (h & U(0xFFFFFFFE)).astype(np.uint32))
    least = least.reshape(n, BINS)
    # an empty bin takes the value of the next filled one, marked with the distance
    twice = np.concatenate((least, least), 1)
    at = np.where(twice != 0xFFFFFFFF, np.arange(2 * BINS), 4 * BINS)
    at = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1][:, :BINS]
    value = np.take_along_axis(twice, at, 1).astype(U) + (at - np.arange(BINS)).astype(U) * hashing.FOLD
    grouped = hashing.mix(value).reshape(n, BANDS, ROWS)
    key = np.zeros((n, BANDS), U)
    for j in range(ROWS):
        key = key * hashing.FOLD + grouped[:, :, j]
    return hashing.mix(key + np.arange(BANDS, dtype=U) * hashing.BASE)


_MARKED = pa.schema([("id", pa.int64()), ("doc", pa.string()), ("lines", pa.list_(pa.binary())), ("shard", pa.int32()), ("pairs", pa.binary())])


def _marker(shard_bits: int):
    """Of documents (id, text): a row with the names of its lines (null: always stays), and packed band rows of the distinct lines of a task."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(held)  # [(key, line)]
        pairs = pairs[np.argsort(pairs[:, 0])]
        cut = np.searchsorted(pairs[:, 0], np.arange(1, 1 << shard_bits, dtype=U) << U(64 - shard_bits))
        rows = [(s, pairs[a:b].tobytes()) for s, (a, b) in enumerate(zip([0, *cut.tolist()], [*cut.tolist(), len(pairs)], strict=True)) if a < b]
        none = pa.nulls(len(rows))
        return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.string()), none.cast(pa.list_(pa.binary())), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_MARKED)

    def run(batches):
        held, n, seen = [], 0, set()
        fresh, fresh_names, size = [], [], 0

        def hashed():
            nonlocal fresh, fresh_names, size, n
            if fresh:
                keys = bands(fresh)
                ids = np.repeat(np.frombuffer(b"".join(x[:8] for x in fresh_names), ">u8").astype(U), BANDS)
                held.append(np.stack((keys.ravel(), ids), 1))
                n += keys.size
                fresh, fresh_names, size = [], [], 0

        for b in batches:
            ids, docs, lines = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                names = []
                for line in text.split("\n"):
                    if not (plain := normal(line)):
                        names.append(None)
                        continue
                    own = name(line)
                    names.append(own)
                    if own not in seen:
                        seen.add(own)
                        fresh.append(plain)
                        fresh_names.append(own)
                        size += len(plain)
                        if size >= CHUNK:
                            hashed()
                ids.append(i)
                docs.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest())
                lines.append(names)
            none = pa.nulls(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(docs, pa.string()), pa.array(lines, pa.list_(pa.binary())), none.cast(pa.int32()), none.cast(pa.binary())], schema=_MARKED)
            if n >= FLUSH:
                yield flush(held)
                held, n, seen = [], 0, set()
        hashed()
        if held:
            yield flush(held)

    return run


def _crowded(table: pa.Table) -> pa.Table:
    """Of a shard: (bucket, line) of the band keys that two different lines have."""
    pairs = np.frombuffer(b"".join(table.column("pairs").to_pylist()), U).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0])]
    same = pairs[1:, 0] == pairs[:-1, 0]
    pairs = pairs[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    if len(pairs):
        pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))]
        same = pairs[1:, 0] == pairs[:-1, 0]
        pairs = pairs[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    return pa.table({"bucket": pa.array(np.ascontiguousarray(pairs[:, 0]).view(np.int64)), "id": pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))})


def _among(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which numbers are in a sorted table."""
    if not len(table):
        return np.zeros(len(numbers), bool)
    return table[np.minimum(np.searchsorted(table, numbers), len(table) - 1)] == numbers


def _fetcher(shared):
    """Of texts: (id, line) of the lines asked for, or of all, each once in a task (or in SEEN lines)."""

    def run(batches):
        wanted = None if shared is None else shared.value
        seen = set()
        for b in batches:
            ids, lines = [], []
            for text in b.column(0):
                own = [line for line in (text.as_py() or "").split("\n") if line]
                numbers = np.frombuffer(b"".join(name(line)[:8] for line in own), ">i8").astype(np.int64)
                asked = range(len(own)) if wanted is None else np.flatnonzero(_among(wanted, numbers)).tolist()
                for i in asked:
                    if (number := int(numbers[i])) not in seen:
                        seen.add(number)
                        ids.append(number)
                        lines.append(normal(own[i]))
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], ["id", "line"])

    return run


def _sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of the distinct shingles of some lines."""
    row, h = shingles(lines)
    return hashing.distinct(row, h, len(lines))[:2]


def _features(bodies: pa.Array):
    """The shingles of a column of lines: row, hash, weight 1."""
    row, h = _sets(bodies.to_pylist())
    return row, h, np.ones(len(h))


def _verifier(batches):
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            sets = []
            for c in (2, 3):
                texts = part.column(c).to_pylist()
                row, h = _sets(texts)
                cut = np.searchsorted(row, np.arange(len(texts) + 1))
                sets.append([h[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)])
            got = []
            for x, y in zip(*sets, strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                got.append(common / max(1, len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.float64())], ["a", "b", "similarity"])


def _small(df: DataFrame, count: int | None = None):
    return F.broadcast if (df.count() if count is None else count) <= BROADCAST else (lambda x: x)


def doomed(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: float = REACH) -> DataFrame:
    """(_line_id, _line_doc, _line_gone): for each document that loses lines, its id, the md5 of its text, and the numbers of the lines."""
    with Scratch(docs.sparkSession) as scratch:
        return scratch.keep(_doomed(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), reach))


def _doomed(rows: DataFrame, reach: float) -> DataFrame:
    spark = rows.sparkSession
    shard_bits = min(20, max(6, math.ceil(math.log2(max(1, rows.count() / DOCS_PER_SHARD)))))
    marked = stored(rows.mapInArrow(_marker(shard_bits), "id long, doc string, lines array<binary>, shard int, pairs binary"))
    packed = marked.where("shard IS NOT NULL").select("shard", "pairs")
    members = stored(packed.groupBy("shard").applyInArrow(_crowded, "bucket long, id long"))
    wanted = stored(members.select("id").distinct())
    n = wanted.count()
    if n <= BROADCAST:
        shared = spark.sparkContext.broadcast(np.sort(wanted.toArrow().column("id").to_numpy()))
        bodies = rows.select("text").mapInArrow(_fetcher(shared), "id long, line string")
    else:
        bodies = rows.select("text").mapInArrow(_fetcher(None), "id long, line string").join(wanted, "id", "left_semi")
    bodies = stored(bodies.dropDuplicates(["id"]).select("id", F.col("line").alias("body")))

    roots = links.components(links.linked(members, bodies, _verifier, _features, reach))
    places = marked.where("shard IS NULL").select("id", "doc", F.posexplode("lines").alias("at", "name")).where("name IS NOT NULL")
    number = F.conv(F.hex(F.substring("name", 1, 8)), 16, -10).cast("long")
    place = F.struct("id", "doc", "at")
    counts = places.groupBy("name").agg(F.count("*").alias("n")).withColumn("number", number)
    many = counts.join(_small(roots)(roots.withColumnRenamed("id", "number")), "number", "left").where("n > 1 OR root IS NOT NULL")
    # a line outside all components is its own
    own = F.when(F.col("root").isNull(), F.col("name")).otherwise(F.col("root").cast("string").cast("binary"))
    many = stored(many.select("name", "n", own.alias("own")))
    # only places of lines that repeat or are linked go on
    found = stored(dealt_join(places, many, ["name"], "n").select("id", "doc", "at", "own"))
    stays = stored(found.groupBy("own").agg(F.min(place).alias("stays"), F.count("*").alias("n")))
    gone = dealt_join(found, stays, ["own"], "n").where(place != F.col("stays"))
    return gone.groupBy(F.col("id").alias("_line_id"), F.col("doc").alias("_line_doc")).agg(F.sort_array(F.collect_set("at")).alias("_line_gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: float = REACH, counts: bool = False) -> DataFrame:
    """docs with the lines that repeat others taken out; with counts, also n_lines and n_dropped."""
    gone = doomed(docs, key, text, reach)
    marked = docs.withColumn("_line_own", F.md5(text))
    on = F.col(key).cast("long").eqNullSafe(F.col("_line_id")) & (F.col("_line_own") == F.col("_line_doc"))
    joined = marked.join(_small(gone)(gone), on, "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_line_gone", i)), "\n")
    names = [c for c in docs.columns if c != text]
    new = F.when(F.col("_line_gone").isNull(), F.col(text)).otherwise(kept).alias(text)
    out = [new if c == text else F.col(c) for c in docs.columns] if text in docs.columns else [*names, new]
    breaks = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    more = [F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_line_gone"), F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*out, *(more if counts else []))
