"""Document fingerprints: a quartile bucket digest of hashed byte triplets, in the manner of locality-sensitive digests.

Of every window of five bytes the triplets (1,2,3), (1,2,4) and (1,3,5) are hashed, each kind with its own tables, into 128
buckets. The digest is the length code and, for every bucket, which quartile of the bucket counts it lies in (two bits).
Two digests are compared by a bounded difference: the sum over buckets of the quartile distance (a distance of three counts as six), plus a length
term; likeness is 1 - difference / greatest difference. A digest is 2 + 64 hexadecimal digits.

``with_next`` gives each row the row that follows it in the order of its key: rows are dealt out by ranges of the key and sorted within a
range; only the last row of each range needs the first text of the next range, and gets it in a second step: a window over the numbers of the ranges
tells which range is next, and a join on that number brings the text.

Defined results: a null text is empty; texts under five bytes are padded with zero bytes for the triplets; equal texts have equal
digests; of rows with equal keys the order is by text; null keys come first; an empty table gives no rows; extra columns are ignored;
the table's only row follows itself.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import stored

BUCKETS = 128
#: Offsets in the window of each kind of triplet.
KINDS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
#: Greatest difference: 6 for every bucket, and the length term's bound.
LENGTH_BOUND = 24
FARTHEST = 6 * BUCKETS + LENGTH_BOUND


def _tables(seed: int = 20) -> np.ndarray:
    """One table of bucket numbers for each kind and place in the triplet."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, BUCKETS, (len(KINDS), 3, 256), dtype=np.uint8)


_TABLES = _tables()
#: Quartile distance of two packed pairs of two bits: a byte of the xor isn't enough, so a table by both bytes.
_Q = np.array([[6 if abs(a - b) == 3 else abs(a - b) for b in range(4)] for a in range(4)])
_BYTE = np.array([[sum(_Q[x >> s & 3, y >> s & 3] for s in (0, 2, 4, 6)) for y in range(256)] for x in range(256)], dtype=np.int32)


def counts(data: bytes) -> np.ndarray:
    """How many triplets fall in each bucket."""
    b = np.frombuffer(data.ljust(5, b"\0"), np.uint8)
    n = len(b) - 4
    total = np.zeros(BUCKETS, np.int64)
    for kind, places in enumerate(KINDS):
        h = _TABLES[kind, 0][b[places[0] : places[0] + n]]
        h ^= _TABLES[kind, 1][b[places[1] : places[1] + n]]
        h ^= _TABLES[kind, 2][b[places[2] : places[2] + n]]
        total += np.bincount(h, minlength=BUCKETS)
    return total


def fingerprint(text: str | None) -> str:
    """The digest of a text, as hexadecimal digits."""
    data = (text or "").encode()
    c = counts(data)
    s = np.sort(c)
    q = (c[:, None] > s[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]).sum(1).astype(np.uint8).reshape(-1, 4)
    length = min(255, round(8 * math.log2(1 + len(data))))
    return bytes([length, *(q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6)]).hex()


def difference(a: str, b: str) -> int:
    """From 0 (equal digests) to FARTHEST."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    return int(_BYTE[x[1:], y[1:]].sum()) + min(LENGTH_BOUND, abs(int(x[0]) - int(y[0])))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0."""
    return 1 - difference(a, b) / FARTHEST


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the following text (or all it has)."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_RESULT = [("key", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_EDGE = [("part", pa.int64()), ("first_text", pa.string()), ("first_print", pa.string()), ("last_key", pa.int64()), ("last_text", pa.string())]
_RESULT_DDL = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def described(key: int | None, text: str, own: str, following: str, after: str) -> dict:
    """The result of a document: its text and digest, and those of the document that follows."""
    changed = edited(text, following)
    other = fingerprint(changed)
    return {"key": key, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": own, "edited_fingerprint": other, "near_edited": likeness(own, other), "near_next": likeness(own, after)}


def _within(batches):
    """Of a sorted partition: a result for each row but the last, then its edge: first text, and the last row that still waits."""
    from pyspark import TaskContext

    schema = pa.schema(_RESULT + _EDGE)
    first = held = None
    for b in batches:
        out = []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            now = (key, text, fingerprint(text))
            if held is not None:
                out.append(described(*held, *now[1:]))
            first, held = first or now, now
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first_text": first[1], "first_print": first[2], "last_key": held[0], "last_text": held[1]}], schema=schema)


def _across(batches):
    """The last rows of partitions, with the first text of the partition that follows."""
    for b in batches:
        rows = [described(r["last_key"], r["last_text"], fingerprint(r["last_text"]), r["following"], r["after"]) for r in b.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_RESULT))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The document that follows is the next by ascending key; the first follows the last. The results and the edges of
    partitions (a row for each) are stored once, so both are of the same partitioning.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    done = stored(dealt.mapInArrow(_within, _RESULT_DDL + ", part long, first_text string, first_print string, last_key long, last_text string"))
    ends = done.where("part IS NOT NULL")
    order = Window.orderBy("part")  # a number for each partition, nothing else
    wrap = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nexts = ends.select("part").select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(wrap)).alias("next"))
    firsts = ends.select(F.col("part").alias("next"), F.col("first_text").alias("following"), F.col("first_print").alias("after"))
    edges = ends.select("part", "last_key", "last_text").join(nexts, "part").join(firsts, "next").select("last_key", "last_text", "following", "after")
    names = [n for n, _ in _RESULT]
    return done.where("part IS NULL").select(names).unionByName(edges.mapInArrow(_across, _RESULT_DDL)).withColumnRenamed("key", key)
