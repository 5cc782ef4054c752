"""Mergeable accumulators: sums, moments, histograms and t-digests.

An accumulator has a state of a few columns, made by init, fed by update, put together by merge and turned into a result by finish. Every task keeps one state
for each group; states are merged in two steps, first within SALT shares of a group, then these; so no task gets all states of a group, and a group of any
size never meets in one task. States are columns like any other: they can be stored, and rolled up to fewer keys later.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import exact
from quillon.operators.descriptive import clean, present
from quillon.operators.errors import DomainError
from quillon.operators.order import group_key

DELTA = 100.0
#: Shares of a group whose states are merged apart.
SALT = 64
#: Most groups that a task holds; it gives out their states and begins anew.
MOST_GROUPS = 100_000


class Accumulator(ABC):
    """The contract. State and result are tuples with the fields of their DDL; values are finite or infinite, never missing."""

    #: DDL of the state's columns.
    state: str
    #: DDL of the result's columns.
    result: str

    @abstractmethod
    def init(self) -> tuple:
        """The state of no values."""

    @abstractmethod
    def update(self, state: tuple, x: np.ndarray) -> tuple:
        """The state after more values."""

    @abstractmethod
    def merge(self, a: tuple, b: tuple) -> tuple:
        """The state of the values of both."""

    @abstractmethod
    def finish(self, state: tuple) -> tuple:
        """The result of a state."""


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


_KINDS = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}


def _schema(ddl: str) -> pa.Schema:
    """key, salt and the columns of a DDL."""
    return pa.schema([("key", pa.string()), ("salt", pa.int64()), *((f.split()[0], _KINDS[f.split()[1]]) for f in ddl.split(", "))])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)


def _task_states(rows: DataFrame, acc: Accumulator) -> DataFrame:
    """(key, salt, state) of (key, x) rows: one row for each task and group."""

    def run(batches):
        from pyspark import TaskContext

        salt, held = TaskContext.get().partitionId() % SALT, {}
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            codes, keys = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            order = np.argsort(codes, kind="stable")
            x = b.column(1).to_numpy()[order]
            cut = np.searchsorted(codes[order], np.arange(len(keys) + 1))
            for i, k in enumerate(keys):
                held[k] = acc.update(held.get(k) or acc.init(), x[cut[i] : cut[i + 1]])
            if len(held) > MOST_GROUPS:
                yield _batch([(k, salt, *s) for k, s in held.items()], acc.state)
                held = {}
        yield _batch([(k, salt, *s) for k, s in held.items()], acc.state)

    return rows.mapInArrow(run, f"key string, salt long, {acc.state}")


def _merged(states: DataFrame, acc: Accumulator) -> DataFrame:
    """(key, salt, state) rows merged within a key, by way of the shares."""
    names = _names(acc.state)

    def run(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(c).to_pylist() for c in names), strict=True))
        while len(rows) > 1:  # by pairs, so that states of like size meet
            rows = [acc.merge(*rows[i : i + 2]) if i + 1 < len(rows) else rows[i] for i in range(0, len(rows), 2)]
        return pa.Table.from_batches([_batch([(t.column("key")[0].as_py(), t.column("salt")[0].as_py(), *rows[0])], acc.state)])

    ddl = f"key string, salt long, {acc.state}"
    return states.groupBy("key", "salt").applyInArrow(run, ddl).groupBy("key").applyInArrow(run, ddl)


def _grouped(key_rows: DataFrame, keys: tuple[str, ...], source: DataFrame, cols: list[str]) -> DataFrame:
    """The groups' own columns in place of the key."""
    if not keys:
        return key_rows.select(*cols)
    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    return key_rows.withColumn("_k", F.from_json("key", kinds)).select(*(F.col("_k")[k].alias(k) for k in keys), *cols)


def accumulate(df: DataFrame, acc: Accumulator, value: str | Column, *keys: str) -> DataFrame:
    """keys and the columns of the state: one row for each group that has values that aren't missing."""
    rows = df.where(present(value)).select(group_key(keys).alias("key"), clean(value).alias("x"))
    return _grouped(_merged(_task_states(rows, acc), acc), keys, df, _names(acc.state))


def roll_up(states: DataFrame, acc: Accumulator, *keys: str) -> DataFrame:
    """States of finer groups (rows with the columns of the state) merged to those of the keys."""
    names = _names(acc.state)
    rows = states.select(group_key(keys).alias("key"), F.pmod(F.xxhash64(*names), F.lit(SALT)).alias("salt"), *names)
    return _grouped(_merged(rows, acc), keys, states, names)


def finish(states: DataFrame, acc: Accumulator) -> DataFrame:
    """The columns that aren't the state's, and the result of every row."""
    names = _names(acc.state)
    others = [c for c in states.columns if c not in names]

    def run(batches):
        for b in batches:
            done = [acc.finish(s) for s in zip(*(b.column(c).to_pylist() for c in names), strict=True)]
            made = [pa.array([r[i] for r in done], _KINDS[f.split()[1]]) for i, f in enumerate(acc.result.split(", "))]
            yield pa.RecordBatch.from_arrays([*(b.column(f"_k{i}") for i in range(len(others))), *made], [*(f"_k{i}" for i in range(len(others))), *_names(acc.result)])

    ready = states.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(others)), *names)
    kinds = "".join(f"_k{i} {states.schema[c].dataType.simpleString()}, " for i, c in enumerate(others))
    out = ready.mapInArrow(run, kinds + acc.result)
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(others)), *_names(acc.result))


# --- sums and moments -----------------------------------------------------------------------------------------------


def expansion(x: list[float]) -> list[float]:
    """A few numbers of falling size whose exact sum is that of x, which must be finite."""
    out: list[float] = []
    while True:
        r = math.fsum(x)
        if r == 0:
            return out
        out.append(r)
        x = [*x, -r]


class Sum(Accumulator):
    """The correctly rounded sum: the state holds the exact sum as an expansion, so neither the split nor the order of rows changes a bit.

    Values that aren't finite, or an overflow, make it what IEEE sums give.
    """

    state = "n long, parts array<double>, odd double"
    result = "n long, sum double"

    def init(self) -> tuple:
        return 0, [], 0.0

    def update(self, state: tuple, x: np.ndarray) -> tuple:
        fine = np.isfinite(x)
        whole = fine.all()
        return self.merge(state, (len(x), *self._parts(x.tolist() if whole else x[fine].tolist()), 0.0 if whole else float(x[~fine].sum())))

    @staticmethod
    def _parts(x: list[float]) -> tuple[list[float]]:
        try:
            return (expansion(x),)
        except OverflowError:
            return ([float(v) for v in x] if len(x) < 8 else [float(np.sum(x))],)

    def merge(self, a: tuple, b: tuple) -> tuple:
        parts = [*a[1], *b[1]]
        odd = a[2] + b[2]
        if all(map(math.isfinite, parts)):
            try:
                return a[0] + b[0], expansion(parts) if a[1] and b[1] else parts, odd
            except OverflowError:
                pass
        return a[0] + b[0], [], odd + float(np.sum(parts))

    def finish(self, state: tuple) -> tuple:
        return state[0], state[2] + (math.fsum(state[1]) if state[1] else 0.0)


class Moments(Accumulator):
    """Count, mean, variance (n - 1), skewness and excess kurtosis, from central sums that are merged pairwise. Null where there are too few values, NaN skewness where all are equal."""

    state = "n long, mean double, m2 double, m3 double, m4 double"
    result = "n long, mean double, var double, skewness double, kurtosis double"

    def init(self) -> tuple:
        return 0, 0.0, 0.0, 0.0, 0.0

    def update(self, state: tuple, x: np.ndarray) -> tuple:
        if not len(x):
            return state
        mean = float(x.mean())
        d = x - mean
        mean += float(d.mean())  # the second pass takes the rounding of the first out
        d = x - mean
        return self.merge(state, (len(x), mean, float((d * d).sum()), float((d**3).sum()), float((d**4).sum())))

    def merge(self, a: tuple, b: tuple) -> tuple:
        if not a[0] or not b[0]:
            return a if a[0] else b
        (p, ma, a2, a3, a4), (q, mb, b2, b3, b4) = a, b
        n, d = p + q, mb - ma
        m2 = a2 + b2 + d * d * p * q / n
        m3 = a3 + b3 + d**3 * p * q * (p - q) / n**2 + 3 * d * (p * b2 - q * a2) / n
        m4 = a4 + b4 + d**4 * p * q * (p * p - p * q + q * q) / n**3 + 6 * d * d * (p * p * b2 + q * q * a2) / n**2 + 4 * d * (p * b3 - q * a3) / n
        return n, ma + d * q / n, m2, m3, m4

    def finish(self, state: tuple) -> tuple:
        n, mean, m2, m3, m4 = state
        var = m2 / (n - 1) if n > 1 else None
        if n < 3:
            return n, mean, var, None, None
        flat = not m2 > 0
        g1 = math.nan if flat else math.sqrt(n) * m3 / m2**1.5
        return n, mean, var, g1, math.nan if flat else n * m4 / m2**2 - 3


class Histogram(Accumulator):
    """Counts of bins of one width from lo to hi, the last one closed, and of values beyond."""

    state = "counts array<long>, underflow long, overflow long"
    result = state

    def __init__(self, lo: float, hi: float, bins: int) -> None:
        if not (math.isfinite(lo) and math.isfinite(hi) and lo < hi) or bins < 1:
            raise DomainError("needs lo < hi, both finite, and a bin at least")
        self.lo, self.hi, self.bins = lo, hi, bins

    def init(self) -> tuple:
        return [0] * self.bins, 0, 0

    def update(self, state: tuple, x: np.ndarray) -> tuple:
        inside = x[(x >= self.lo) & (x <= self.hi)]
        at = np.minimum(np.floor((inside - self.lo) / ((self.hi - self.lo) / self.bins)).astype(np.int64), self.bins - 1)
        return self.merge(state, (np.bincount(at, minlength=self.bins).tolist(), int((x < self.lo).sum()), int((x > self.hi).sum())))

    def merge(self, a: tuple, b: tuple) -> tuple:
        return [int(p + q) for p, q in zip(a[0], b[0], strict=True)], a[1] + b[1], a[2] + b[2]

    def finish(self, state: tuple) -> tuple:
        return state


def exact_sum(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, n, sum: correctly rounded sums, the same under any partitioning, without Python workers. Sum is the same as an accumulator."""
    return exact.sums(df, value, *keys)


# --- t-digest -------------------------------------------------------------------------------------------------------


def compress(means: np.ndarray, weights: np.ndarray, delta: float = DELTA) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted neighbours while they span at most one unit of the scale delta / (2 pi) asin(2 q - 1)."""
    if not len(means):
        return means, weights
    total = weights.sum()
    edge = np.concatenate(([0.0], np.cumsum(weights))) / total
    k = delta / (2 * math.pi) * np.arcsin(np.clip(2 * edge - 1, -1, 1))
    out_m, out_w, start = [], [], 0
    n = len(means)
    while start < n:
        end = max(start + 1, int(np.searchsorted(k, k[start] + 1 + 1e-12, "right")) - 1)
        w = weights[start:end].sum()
        out_w.append(w)
        out_m.append(float((means[start:end] * weights[start:end]).sum() / w) if end > start + 1 else means[start])
        start = end
    return np.array(out_m), np.array(out_w)


class Digest(Accumulator):
    """A t-digest: count, exact ends, and centroids of at most one unit of the scale."""

    state = "n long, least double, most double, means array<double>, weights array<double>"
    result = state

    def __init__(self, delta: float = DELTA) -> None:
        if not delta >= 1:
            raise DomainError("delta must be 1 at least")
        self.delta = delta

    def init(self) -> tuple:
        return 0, math.inf, -math.inf, [], []

    def update(self, state: tuple, x: np.ndarray) -> tuple:
        if not len(x):
            return state
        x = np.sort(x)
        m, w = compress(x, np.ones(len(x)), self.delta)
        return self.merge(state, (len(x), float(x[0]), float(x[-1]), m, w))

    def merge(self, a: tuple, b: tuple) -> tuple:
        if not a[0] or not b[0]:
            return a if a[0] else b
        m, w = np.concatenate((a[3], b[3])), np.concatenate((a[4], b[4]))
        order = np.argsort(m, kind="stable")
        return a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), *compress(m[order], w[order], self.delta)

    def finish(self, state: tuple) -> tuple:
        return state


def tdigest(df: DataFrame, value: str, *keys: str, delta: float = DELTA) -> DataFrame:
    """keys, digest: a struct of n, least, most, and centroids (means, weights) of each group; exact least and greatest value."""
    return accumulate(df, Digest(delta), value, *keys).select(*keys, F.struct(*_names(Digest.state)).alias("digest"))


def _anchors(digest: Column) -> tuple[Column, Column]:
    """Values and ranks (0 to 1) through which a digest's quantile function runs."""
    w, total = digest["weights"], digest["n"].cast("double")
    # running sums by one pass over the array
    sums = F.aggregate(w, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    mid = F.transform(w, lambda x, i: (F.element_at(sums, i + 1) + x / 2) / total)
    return F.concat(F.array(digest["least"]), digest["means"], F.array(digest["most"])), F.concat(F.array(F.lit(0.0)), mid, F.array(F.lit(1.0)))


def _interpolated(at: Column, xs: Column, ys: Column) -> Column:
    """y at x, linear between points with rising xs."""
    k = F.greatest(F.lit(1), F.least(F.size(xs) - 1, F.size(F.filter(xs, lambda v: v <= at))))
    x0, x1, y0, y1 = F.element_at(xs, k), F.element_at(xs, k + 1), F.element_at(ys, k), F.element_at(ys, k + 1)
    return F.when(x1 > x0, y0 + (y1 - y0) * (at - x0) / F.nullif(x1 - x0, F.lit(0.0))).otherwise(y1)


def tdigest_quantile(digest: str | Column, q: float | Column) -> Column:
    """The quantile of a digest; exact at 0 and 1."""
    d = F.col(digest) if isinstance(digest, str) else digest
    q = q if isinstance(q, Column) else F.lit(float(q))
    values, ranks = _anchors(d)
    return F.when(q <= 0, d["least"]).when(q >= 1, d["most"]).otherwise(_interpolated(q, ranks, values))


def tdigest_cdf(digest: str | Column, x: float | Column) -> Column:
    """The share of values up to x; 0 below the least, 1 above the greatest."""
    d = F.col(digest) if isinstance(digest, str) else digest
    x = x if isinstance(x, Column) else F.lit(float(x))
    values, ranks = _anchors(d)
    return F.when(x < d["least"], 0.0).when(x >= d["most"], 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _interpolated(x, values, ranks))))


def quantile_edges(digest: str | Column, k: int) -> Column:
    """k + 1 edges of equal frequency."""
    if k < 1:
        raise DomainError("k must be 1 at least")
    return F.array(*(tdigest_quantile(digest, i / k) for i in range(k + 1)))


# --- histogram ------------------------------------------------------------------------------------------------------


def bin_of(c: str | Column, lo: float, hi: float, bins: int) -> Column:
    """The bin (from 0) of a value: [edge, next edge), the last one closed; -1 below, bins above, null where missing."""
    x = clean(c)
    width = (hi - lo) / bins
    return F.when(x < lo, -1).when(x > hi, bins).when(x.isNotNull(), F.least(F.floor((x - lo) / width), F.lit(bins - 1))).cast("int")


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, *keys: str) -> DataFrame:
    """keys, counts (array), edges (array), underflow, overflow of each group."""
    if not (math.isfinite(lo) and math.isfinite(hi) and lo < hi) or bins < 1:
        raise DomainError("needs lo < hi, both finite, and a bin at least")
    b = bin_of(value, lo, hi, bins)
    counted = df.select(*keys, b.alias("_b")).where("_b IS NOT NULL").groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    maps = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_b", "_n"))).alias("_m"))  # at most bins + 2 entries
    at = lambda i: F.coalesce(F.try_element_at(F.col("_m"), i.cast("int")), F.lit(0).cast("long"))
    edges = F.array(*(F.lit(lo + i * (hi - lo) / bins if i < bins else hi) for i in range(bins + 1)))
    return maps.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), at).alias("counts"), edges.alias("edges"), at(F.lit(-1)).alias("underflow"), at(F.lit(bins)).alias("overflow"))


def ecdf(counts: str | Column) -> Column:
    """The share of in-range values up to each bin; NaN for all where there are none."""
    c = F.col(counts) if isinstance(counts, str) else counts
    total = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    upto = lambda i: F.aggregate(F.slice(c, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(c, lambda _, i: F.when(total > 0, upto(i) / F.nullif(total, F.lit(0))).otherwise(F.lit(float("nan"))))
