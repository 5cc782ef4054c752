"""Exact top-k search by inner product, score at a time over an impact-ordered index.

The components of the vectors are postings (component -> vector, value), cut into segments by quantised impact: the binary magnitude of
the value. For a block of queries, segments are taken in descending impact; every vector's partial score then lies within
|query| x |what is left of the vector| of its score. A block stops early only on the proof that all vectors but a few can't reach the
k-th best score that is already certain; the possible members are then scored exactly, in integers.

Queries go out in blocks of QUERY_BLOCK; each block is one pass of the candidates, of which every task keeps k rows for a query. With several blocks, a
block's results are stored and its broadcast is destroyed before the next. So what is broadcast and what a task or the driver holds don't grow with the table. Results of tasks meet in one ranking for each query.

Defined results: vectors that are null, or hold a null or a non-finite component, take no part, neither do null ids; vectors of unequal
length are taken as followed by zeros; empty vectors score 0; a query never finds rows of its own id; ties go to the smaller id, repeated
candidates each take a place; repeated query rows count once (the greatest vector); no queries or no candidates: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import stored

QUERY_BLOCK = 16_384
#: Queries and candidates that are scored together.
ROWS, COLUMNS = 512, 4096
#: A block stops once this many possible members for each query and place are left.
ENOUGH = 4
SCALE = 1024


def quantised(vector: str | Column = "embedding", scale: int = SCALE) -> Column:
    """The vector's components as floor(scale * x), with x as a double."""
    return F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: str = "embedding") -> Column:
    """Whether a vector takes part."""
    x = F.col(vector)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(math.inf)))


def _matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of numbers, padded with zeros to the longest (or to width)."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    top = max(int(sizes.max(initial=0)), width)
    if len(sizes) and (sizes == top).all():
        return flat.reshape(len(sizes), top)
    out = np.zeros((len(sizes), top), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Segments:
    """An impact-ordered index of a batch of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        x = vectors.astype(float)
        level = np.frexp(x)[1] * (x != 0)  # |x| < 2 ** level
        self.segments, left = [], (x * x).sum(1)
        self.whole = np.sqrt(left)
        for k in sorted(np.unique(level[x != 0]).tolist(), reverse=True):
            part = np.where((level == k) & (x != 0), x, 0.0)
            left = np.maximum(left - (part * part).sum(1), 0.0)
            self.segments.append((part, np.sqrt(left * (1 + 1e-9))))
        if self.segments:
            self.segments[-1] = (self.segments[-1][0], np.zeros(len(ids)))  # nothing is left


def possible(queries: np.ndarray, query_ids: np.ndarray, index: Segments, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, vector row) that may be among the k best; known: the k-th best score so far of each query, or -inf."""
    q = queries.astype(float)
    norm = np.sqrt((q * q).sum(1))
    own = query_ids[:, None] == index.ids[None, :]
    score = np.where(own, -np.inf, 0.0)
    slack = 2.0**-40 * norm[:, None] * index.whole[None, :] if norm.max(initial=0) * index.whole.max(initial=0) > 2.0**50 else 0.0
    for n, (part, left) in enumerate(index.segments):
        score += q @ part.T
        reach = norm[:, None] * left[None, :] + slack
        certain = known
        if len(index.ids) >= k:
            low = score - reach
            certain = np.maximum(known, np.partition(low, len(index.ids) - k, axis=1)[:, len(index.ids) - k])
        may = (score + reach >= certain[:, None]) & ~own
        if n == len(index.segments) - 1 or may.sum() <= ENOUGH * k * len(q):
            return np.nonzero(may)
    return np.nonzero(~own)  # all vectors are zero


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products; past 64 bits in Python's integers, then held to the range of a long."""
    if not len(queries):
        return np.zeros(0, np.int64)
    if float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1]) < 2.0**62:
        return (queries * vectors).sum(1)
    return np.array([max(min(v, 2**63 - 1), -(2**63)) for v in (queries.astype(object) * vectors.astype(object)).sum(1)], np.int64)


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their row."""
    order = np.lexsort((ids, -scores, rows))
    r = rows[order]
    start = np.searchsorted(r, r)
    return order[np.arange(len(r)) - start < k]


def _search(ids: np.ndarray, vectors: np.ndarray, k: int):
    """A function over Arrow batches of candidates (vec_id, values): the k best of the partition for each query."""

    def run(batches):
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(0, len(ids), ROWS)]
        for b in batches:
            for at in range(0, b.num_rows, COLUMNS):
                part = b.slice(at, COLUMNS)
                own = _matrix(part.column(1), vectors.shape[1])
                wide = np.pad(vectors, ((0, 0), (0, own.shape[1] - vectors.shape[1])))
                index = Segments(part.column(0).to_numpy(), own)
                for n, lo in enumerate(range(0, len(ids), ROWS)):
                    q, q_ids = wide[lo : lo + ROWS], ids[lo : lo + ROWS]
                    rows, scores, found = held[n]
                    known = np.full(len(q), -np.inf)
                    if len(rows):
                        count = np.bincount(rows, minlength=len(q))
                        least = np.full(len(q), np.inf)
                        np.minimum.at(least, rows, scores.astype(float))
                        known = np.where(count >= k, least, known)
                    i, j = possible(q, q_ids, index, known, k)
                    rows, scores, found = (np.concatenate(x) for x in ((rows, i), (scores, exact(q[i], own[j])), (found, index.ids[j])))
                    keep = best(rows, scores, found, k)
                    held[n] = rows[keep], scores[keep], found[keep]
        for n, lo in enumerate(range(0, len(ids), ROWS)):
            rows, scores, found = held[n]
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo + rows]), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every query. vectors: vec_id long, values array<long>."""
    spark = vectors.sparkSession
    ready = vectors.where("vec_id IS NOT NULL AND values IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "values")
    queries = ready.where(is_query).groupBy("vec_id").agg(F.max("values").alias("values"))
    blocks = max(1, math.ceil(queries.count() / query_block * 1.1))
    queries = stored(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")))
    found = None
    for n in range(blocks):
        got = queries.where(F.col("block") == n).toArrow().combine_chunks()
        ids = got.column("vec_id").to_numpy()
        order = np.argsort(ids)
        shared = spark.sparkContext.broadcast((ids[order], _matrix(got.column("values"))[order]))
        one = ready.mapInArrow(lambda batches, s=shared: _search(*s.value, k)(batches), "query_id long, vec_id long, score long")
        if blocks > 1:  # a block's results are stored before the next block goes out
            one = stored(ranked(one, k))
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    return ranked(found, k) if blocks == 1 else found


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every query, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
