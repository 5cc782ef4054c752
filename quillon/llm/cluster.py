"""Centroid clustering (Lloyd's rounds) of integer vectors, with exact results.

Every round is one pass over the vectors. A task takes a batch and the centroids, both as float32, and multiplies them: of |x - c|^2 only |c|^2 - 2 x.c depends on the centroid. The
product of n components errs by no more than gamma(n + 2) |x| |c|, whatever the order of its sums (gamma(m) = m u / (1 - m u), u = 2^-24; two of the factors are the rounding of x and c
themselves), so every centroid has an interval in which its distance must lie. Centroids whose interval begins above the least upper end can't be nearest. Where one is left, it is the
nearest; where several are left, their distances are computed in integers, and ties go to the smaller number. Sums of a cluster are integers too: a task gives one row for each
cluster, Spark adds them, and the new centroid is the floor of sum / count. So the result depends neither on the partitions nor on the order of rows.

Bounds: the centroids, k x width numbers, are the model; they are collected and sent out each round, at most LARGEST numbers. The quantised vectors are stored once and
read in each round; no vector is shuffled, so copies of one vector make no hot task.

Defined results: vectors that are null, of another width, or hold a null or a non-finite component take no part; with fewer vectors than k, each is a centroid; of rows with equal ids
both take part and each gets a row, and the one with the smaller components is the earlier first centroid; null ids come last among first centroids; an empty cluster keeps its
centroid; no vectors: no rows. Components are floor(scale x) as longs, at their ends if beyond; a distance or an inertia beyond a long is null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import stored
from quillon.llm.topk import _matrix, quantised, usable

#: Most numbers of all centroids.
LARGEST = 1 << 24
#: Rows that are multiplied at once.
ROWS = 8192
_LONG = (1 << 63) - 1


def exact_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in integers: of 64 bits where they suffice, else of any size."""
    most = max(int(np.abs(a.astype(float)).max(initial=0)) for a in (x, c))
    if x.shape[1] * (2 * most) ** 2 * 1.01 < _LONG:
        return ((x - c) ** 2).sum(1)
    return ((x.astype(object) - c.astype(object)) ** 2).sum(1)


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of |c|^2 - 2 x.c for every row and centroid, by a float32 product."""
    n = x.shape[1]
    u32, u64 = 2.0**-24, 2.0**-53
    with np.errstate(all="ignore"):
        dot = (x.astype(np.float32) @ c.astype(np.float32).T).astype(float)
        xs, cs = x.astype(float), c.astype(float)
        own = (cs * cs).sum(1)
        slack = 1 + 4 * (n + 8) * u64  # the norms are rounded too
        size = np.sqrt((xs * xs).sum(1))[:, None] * np.sqrt(own)[None, :] * slack
        gamma = (n + 2) * u32 / (1 - (n + 2) * u32)
        middle = own[None, :] - 2 * dot
        half = 2 * gamma * size + 4 * (n + 8) * u64 * (own[None, :] + 2 * np.abs(dot) + 2 * size) + 1e-30
        low, high = middle - half, middle + half
    unknown = ~(np.isfinite(low) & np.isfinite(high))
    low[unknown], high[unknown] = -np.inf, np.inf
    return low, high


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of every row, the smaller number at ties; and how many distances were computed in integers."""
    low, high = intervals(x, c)
    open_ = low <= high.min(1)[:, None]
    found = open_.argmax(1)
    many = np.flatnonzero(open_.sum(1) > 1)
    if not len(many):
        return found, 0
    i, j = np.nonzero(open_[many])  # by row, then by number
    d = exact_distances(x[many[i]], c[j])
    starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
    least = np.minimum.reduceat(d, starts)
    hit = np.flatnonzero(d == np.repeat(least, np.diff(np.append(starts, len(i)))))
    rows, first = np.unique(i[hit], return_index=True)
    found[many[rows]] = j[hit[first]]
    return found, len(d)


def _totals(x: np.ndarray) -> list[int]:
    """Column sums, exact."""
    most = int(np.abs(x.astype(float)).max(initial=0))
    return [int(v) for v in (x if most * 1.01 * len(x) < _LONG else x.astype(object)).sum(0)]


_SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = shared.value
        count, total = [0] * len(c), [[0] * c.shape[1] for _ in c]
        for b in batches:
            x = _matrix(b.column(0))
            for at in range(0, len(x), ROWS):
                part = x[at : at + ROWS]
                found, _ = nearest(part, c)
                for k in np.unique(found).tolist():
                    own = part[found == k]
                    count[k] += len(own)
                    total[k] = [a + s for a, s in zip(total[k], _totals(own), strict=True)]
        rows = [k for k, n in enumerate(count) if n]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([count[k] for k in rows], pa.int64()), pa.array([total[k] for k in rows], _SUMS.field("sums").type)], schema=_SUMS)

    parts = vectors.select("values").mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    sums = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # k x width rows
    shared.destroy()
    out = centroids.copy()
    for r in sums:
        out[r.cluster, r.at] = int(r.s) // r.n
    return out


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least hash of seed and id, in order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(h.alias("h"), "values").orderBy(F.asc_nulls_last("h"), "values").limit(k).collect()
    return np.array([r["values"] for r in rows], np.int64)


def digest(centroid: np.ndarray) -> str:
    """Hex sha256 of the components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector, stored, and the final centroids. vectors: vec_id long, values array<long> of one width."""
    if k < 1 or rounds < 0:
        raise ValueError("needs k >= 1 and rounds >= 0")
    kept = stored(vectors.select("vec_id", "values"))
    c = starts(kept, k, seed)
    if c.size > LARGEST:
        raise ValueError(f"centroids of more than {LARGEST} numbers")
    for _ in range(rounds if len(c) else 0):
        after = _moved(kept, c)
        if np.array_equal(after, c):  # every further round would give the same
            break
        c = after
    shared = kept.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1))
            found, away = [np.zeros(0, np.int32)], [np.zeros(0, object)]
            for at in range(0, len(x), ROWS):
                part = x[at : at + ROWS]
                own, _ = nearest(part, shared.value)
                found.append(own.astype(np.int32))
                away.append(exact_distances(part, shared.value[own]))
            d = [int(v) if v <= _LONG else None for v in np.concatenate(away).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(found)), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    return stored(kept.mapInArrow(run, "vec_id long, cluster int, distance long")), c


def described(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The same rows with cluster_inertia, inertia and centroid_sha256."""
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    rows = assigned.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), whole).alias("s")).collect()  # k rows
    fits = lambda v: None if v is None or v > _LONG else int(v)
    each = {r.cluster: r.s for r in rows}
    total = None if None in each.values() else sum(each.values())
    table = assigned.sparkSession.createDataFrame(
        [(k, fits(s), fits(total), digest(centroids[k])) for k, s in each.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def usable_vectors(df: DataFrame, vector: str = "embedding", width: int = 64, scale: int = 1024, key: str | Column = "vec_id") -> DataFrame:
    """(vec_id, values) of the vectors that take part."""
    key = F.col(key) if isinstance(key, str) else key
    return df.where(usable(vector) & (F.size(vector) == width)).select(key.cast("long").alias("vec_id"), quantised(vector, scale).alias("values"))
