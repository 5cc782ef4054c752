"""Kernel density estimates and histograms with automatic bins."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.descriptive import clean, present
from quillon.operators.errors import DomainError, TooFewObservations
from quillon.operators.storage import dealt_join, stored

#: Grid points that are broadcast at most, where they are.
LARGEST_GRID = 100_000
#: What a density may be off by default, as a share of the greatest density that one value could give.
ERROR = 1e-11
#: Given edges that are broadcast at most.
LARGEST_EDGES = 5_000_000


class Kernel(Enum):
    GAUSSIAN = "gaussian"
    EPANECHNIKOV = "epanechnikov"


@dataclass(frozen=True)
class Bandwidth:
    """silverman, scott, or fixed with a width h."""

    rule: str
    h: float | None = None


SILVERMAN, SCOTT = Bandwidth("silverman"), Bandwidth("scott")


def kernel_value(kernel: Kernel, u: Column) -> Column:
    if kernel is Kernel.GAUSSIAN:
        return F.exp(-0.5 * u * u) / math.sqrt(2 * math.pi)
    return F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0)


def _terms(error: float) -> int:
    """How many terms of the expansion leave an error of at most that: by Cramer's bound a term is at most 1.09 t^p / sqrt(p!), and t is half a width at most."""
    p, left = 0, math.inf
    while left > error:
        p += 1
        left = sum(1.09 * 0.5**q / math.sqrt(math.factorial(q)) for q in range(p, p + 40))
    return p


@dataclass(frozen=True)
class Kde:
    """A fitted estimate: the data as a DataFrame (_data), the width, the number of values, and the finite values' mean and span."""

    data: DataFrame
    bandwidth: float
    n: int
    kernel: Kernel
    origin: float = 0.0
    span: float = math.inf

    def evaluate(self, grid: DataFrame, at: str, error: float = ERROR) -> DataFrame:
        """(at, density) of every distinct grid point; 0 where it isn't finite.

        The Gaussian kernel is summed by cells of one width: each cell's values are kept as a few moments, and a grid point takes the cells near it. What that
        leaves out is at most error times the greatest density that one value could give, 1 / (width sqrt(2 pi)); rows and grid points are read once each, and
        nothing but moments is broadcast. With an error of 0, or where the data span more than 2^40 widths, every value is summed for every point instead: this grid is broadcast, its size
        is checked. The compact kernel joins by cells of its width, so only near values meet.
        """
        if not 0 <= error < 1:
            raise DomainError("the error must be at least 0 and below 1")
        points = grid.select(F.col(at).cast("double").alias(at)).distinct()
        finite = points.where(present(at) & (F.abs(F.col(at)) < math.inf))
        if self.kernel is Kernel.GAUSSIAN and error > 0 and self.span / self.bandwidth < 2.0**40:
            sums = self._by_moments(finite, at, error)
        else:
            sums = self._by_values(finite, at)
        return points.join(sums, at, "left").select(at, (F.coalesce("_s", F.lit(0.0)) / (self.n * self.bandwidth)).alias("density"))

    def _by_values(self, finite: DataFrame, at: str) -> DataFrame:
        if finite.count() > LARGEST_GRID:
            raise DomainError(f"a grid of more than {LARGEST_GRID} points; evaluate it in parts")
        k = kernel_value(self.kernel, (F.col(at) - F.col("_data")) / self.bandwidth)
        if self.kernel is Kernel.EPANECHNIKOV:
            cell = lambda c: F.floor(F.col(c) / self.bandwidth)
            near = finite.withColumn("_cell", F.explode(F.array(cell(at) - 1, cell(at), cell(at) + 1)))
            pairs = self.data.withColumn("_cell", cell("_data")).join(F.broadcast(near), "_cell")
        else:
            pairs = self.data.crossJoin(F.broadcast(finite))  # a checked grid against all rows
        return pairs.groupBy(at).agg(F.sum(k).alias("_s"))

    def _by_moments(self, finite: DataFrame, at: str, error: float) -> DataFrame:
        """Around a cell's middle, exp(-(u - t)^2 / 2) is the sum of He_p(u) exp(-u^2 / 2) t^p / p!, so the moments of t stand for the cell's values."""
        terms, reach = _terms(error / 2), math.ceil(math.sqrt(2 * math.log(2 / error)))
        z = lambda c: (F.col(c) - self.origin) / self.bandwidth
        rows = self.data.where(F.abs("_data") < math.inf).select(z("_data").alias("_z")).select(F.floor("_z").alias("_cell"), (F.col("_z") - F.floor("_z") - 0.5).alias("_t"))
        moments = rows.groupBy("_cell").agg(F.array(*(F.sum(F.pow("_t", F.lit(float(p)))) / math.factorial(p) for p in range(terms))).alias("_m"))
        placed = finite.select(F.col(at).alias("_at"), z(at).alias("_z")).where(F.abs("_z") < 2.0**42)  # beyond it no value is near
        near = placed.withColumn("_cell", F.explode(F.sequence(F.floor("_z") - reach, F.floor("_z") + reach)))
        table = stored(moments.join(near.groupBy("_cell").agg(F.count("*").alias("_n")), "_cell"))  # a cell may hold any number of grid points
        u = F.col("_z") - F.col("_cell") - 0.5

        def step(s: Column, m: Column) -> Column:
            return F.struct(s["he"].alias("last"), (u * s["he"] - s["p"] * s["last"]).alias("he"), (s["p"] + 1.0).alias("p"), (s["sum"] + s["he"] * m).alias("sum"))

        start = F.struct(F.lit(0.0).alias("last"), F.lit(1.0).alias("he"), F.lit(0.0).alias("p"), F.lit(0.0).alias("sum"))
        value = F.aggregate("_m", start, step, lambda s: s["sum"]) * F.exp(-0.5 * u * u) / math.sqrt(2 * math.pi)
        return dealt_join(near, table, ["_cell"], "_n").groupBy(F.col("_at").alias(at)).agg(F.greatest(F.sum(value), F.lit(0.0)).alias("_s"))


def kde(df: DataFrame, value: str, kernel: Kernel, bandwidth: Bandwidth) -> Kde:
    """Fit: two values at least; the rules need a positive, finite deviation."""
    x = clean(value)
    fine = F.when(F.abs(x) < math.inf, x)
    n, sd, mean, lo, hi = df.agg(F.count(x), F.stddev_samp(x), F.avg(fine), F.min(fine), F.max(fine)).first()
    if n < 2:
        raise TooFewObservations(2, n)
    if bandwidth.rule == "fixed":
        h = bandwidth.h
    else:
        if not (sd and math.isfinite(sd) and sd > 0):
            raise DomainError("the deviation must be positive and finite")
        h = sd * (3 * n / 4) ** -0.2 if bandwidth.rule == "silverman" else sd * n**-0.2
    if not (h and math.isfinite(h) and h > 0):
        raise DomainError("the width must be positive and finite")
    known = mean is not None and math.isfinite(mean)
    return Kde(df.where(present(value)).select(x.alias("_data")), h, n, kernel, mean if known else 0.0, hi - lo if known else math.inf)


class Rule(Enum):
    STURGES = "sturges"
    SCOTT = "scott"
    FREEDMAN_DIACONIS = "fd"
    RICE = "rice"
    SQRT = "sqrt"


class Norm(Enum):
    COUNT = "count"
    DENSITY = "density"
    PROBABILITY = "probability"


@dataclass(frozen=True)
class Bins:
    """Exactly one of: count, width, edges, rule."""

    count: int | None = None
    width: float | None = None
    edges: tuple[float, ...] | None = None
    rule: Rule | None = None


def rule_bins(rule: Rule, n: int, lo: float, hi: float, sd: float | None, iqr: float) -> int:
    """The number of bins of a rule; a width of zero gives one bin."""
    by_width = lambda w: max(1, math.ceil((hi - lo) / w)) if w and w > 0 else 1
    return {
        Rule.STURGES: lambda: math.ceil(math.log2(n)) + 1 if n > 1 else 1,
        Rule.SQRT: lambda: math.ceil(math.sqrt(n)),
        Rule.RICE: lambda: math.ceil(2 * n ** (1 / 3)),
        Rule.SCOTT: lambda: by_width(3.49 * (sd or 0) * n ** (-1 / 3)),
        Rule.FREEDMAN_DIACONIS: lambda: by_width(2 * iqr * n ** (-1 / 3)),
    }[rule]()


def _between(values: DataFrame, edges: list[float]) -> DataFrame:
    """(bin, n): how many values lie in each bin that has any. The sorted edges are broadcast, values find their bin by bisection, and a task sends its counts."""
    shared = values.sparkSession.sparkContext.broadcast(np.array(edges, float))

    def run(batches):
        cut = shared.value
        n = np.zeros(len(cut) - 1, np.int64)
        for b in batches:
            x = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            x = x[(x >= cut[0]) & (x <= cut[-1])]
            np.add.at(n, np.minimum(np.searchsorted(cut, x, "right") - 1, len(n) - 1), 1)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], ["bin", "n"])

    return values.mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def histogram_auto(df: DataFrame, value: str, bins: Bins, norm: Norm) -> DataFrame:
    """(bin, lower, upper, value), a row for each bin; the last bin is closed. Values outside given edges are left out."""
    x = clean(value)
    if bins.edges is not None:
        edges = list(bins.edges)
        if len(edges) < 2 or any(not math.isfinite(e) for e in edges) or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
            raise DomainError("edges must rise and be finite")
        if len(edges) > LARGEST_EDGES:
            raise DomainError(f"more than {LARGEST_EDGES} edges; count their ranges in parts")
    else:
        wanted = [F.count(x), F.min(x), F.max(x), F.stddev_samp(x)] + ([F.percentile(x, [0.25, 0.75])] if bins.rule is Rule.FREEDMAN_DIACONIS else [])
        n, lo, hi, sd, *rest = df.agg(*wanted).first()
        if not n or not (math.isfinite(lo) and math.isfinite(hi)) or lo == hi:
            raise DomainError("needs two different, finite values")
        if bins.count is not None:
            k = bins.count
        elif bins.width is not None:
            k = math.ceil((hi - lo) / bins.width) if bins.width > 0 else 0
        else:
            k = rule_bins(bins.rule, n, lo, hi, sd, rest[0][1] - rest[0][0] if rest else 0.0)
        if k < 1:
            raise DomainError("needs a bin at least")
    spark = df.sparkSession
    if bins.edges is None:
        step = lambda i: F.lit(lo) + i.cast("double") * (hi - lo) / k
        at = F.least(F.floor((x - lo) / ((hi - lo) / k)), F.lit(k - 1)).cast("int")
        counts = df.select(at.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
        frame = spark.range(k).select(F.col("id").cast("int").alias("bin"))
        frame = frame.withColumn("lower", step(F.col("bin"))).withColumn("upper", F.when(F.col("bin") == k - 1, F.lit(hi)).otherwise(step(F.col("bin") + 1)))
    else:
        counts = _between(df.select(x.alias("x")), edges)
        frame = spark.createDataFrame(pa.table({"bin": pa.array(range(len(edges) - 1), pa.int32()), "lower": pa.array(edges[:-1], pa.float64()), "upper": pa.array(edges[1:], pa.float64())}))
    out = frame.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    if norm is Norm.COUNT:
        return out.select("bin", "lower", "upper", F.col("n").alias("value"))
    out = out.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all"))))  # one row
    share = F.try_divide(F.col("n"), F.col("all"))
    return out.select("bin", "lower", "upper", (share if norm is Norm.PROBABILITY else share / (F.col("upper") - F.col("lower"))).alias("value"))
