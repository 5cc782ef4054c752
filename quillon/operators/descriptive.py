"""Descriptive aggregates. A missing value is null or NaN and is left out; infinities are kept.

The functions give aggregate Columns for ``groupBy().agg()``; Spark's partial aggregates do the merging. ``describe`` gives a DataFrame.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Ddof(Enum):
    """The divisor of a variance: n - 1 or n. There is no default."""

    SAMPLE = 1
    POPULATION = 0


def _col(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def clean(c: str | Column) -> Column:
    """The value, or null where it is missing."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def present(c: str | Column) -> Column:
    """Whether the value isn't missing."""
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c)


def _paired(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """Both values, or nulls where either is missing."""
    both = present(a) & present(b)
    return F.when(both, _col(a)), F.when(both, _col(b))


def _from(n: Column, least: int, value: Column) -> Column:
    return F.when(n >= least, value)


def count(c) -> Column:
    """Number of values that aren't missing."""
    return F.count(clean(c))


def minimum(c) -> Column:
    return F.min(clean(c))


def maximum(c) -> Column:
    return F.max(clean(c))


def value_range(c) -> Column:
    """max - min."""
    return F.max(clean(c)) - F.min(clean(c))


def mean(c) -> Column:
    return F.avg(clean(c))


def median(c) -> Column:
    """Type-7 median."""
    return F.percentile(clean(c), 0.5)


def quantile(c, q: float | list[float]) -> Column:
    """Type-7 quantiles, exact. The state holds the distinct values of a group; for groups that outgrow a task use accum.tdigest."""
    return F.percentile(clean(c), q)


def var(c, ddof: Ddof) -> Column:
    """Variance; null under two values for either divisor."""
    x = clean(c)
    return _from(F.count(x), 2, F.var_samp(x) if ddof is Ddof.SAMPLE else F.var_pop(x))


def sd(c, ddof: Ddof) -> Column:
    return F.sqrt(var(c, ddof))


def skewness(c) -> Column:
    """g1, without bias correction; NaN for a constant, null under two values."""
    x = clean(c)
    return _from(F.count(x), 2, F.coalesce(F.skewness(x), F.lit(float("nan"))))


def kurtosis(c) -> Column:
    """Excess g2, without bias correction; NaN for a constant, null under two values."""
    x = clean(c)
    return _from(F.count(x), 2, F.coalesce(F.kurtosis(x), F.lit(float("nan"))))


def cov(a, b) -> Column:
    """Sample covariance over complete pairs."""
    x, y = _paired(a, b)
    return _from(F.count(x), 2, F.covar_samp(x, y))


def pearson(a, b) -> Column:
    """Pearson's r over complete pairs; NaN where a side is constant."""
    x, y = _paired(a, b)
    spread = F.var_pop(x) * F.var_pop(y)
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))
    return _from(F.count(x), 2, F.when(spread > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).otherwise(F.lit(float("nan"))))


def describe(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, min, q1, median, q3, max, mean, sd, skewness and kurtosis of each group, from one aggregation.

    Where a group has more than select.FEW values, quartiles come from selection instead, so that no task holds more values of a group.
    """
    from quillon.operators import select

    x = F.col("_x")
    rows = df.select(*keys, clean(value).alias("_x"))
    most = rows.groupBy(*keys).agg(F.count(x).alias("n")).agg(F.max("n")).first()[0] or 0
    few = [F.percentile(x, [0.25, 0.5, 0.75]).alias("q")] if most <= select.FEW else []
    both = rows.groupBy(*keys).agg(
        *few, F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), sd(x, Ddof.SAMPLE).alias("sd"), skewness(x).alias("skewness"), kurtosis(x).alias("kurtosis"))
    if not few:
        q = select.quantiles(rows, "_x", [0.25, 0.5, 0.75], *keys).select(*(F.col(k).alias(f"_q{i}") for i, k in enumerate(keys)), "q")
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_q{i}"))
        both = both.join(q if keys else F.broadcast(q), same, "left")  # without keys, one row
    return both.select(*keys, "n", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max", "mean", "sd", "skewness", "kurtosis")


def logsumexp(df: DataFrame, value: str | Column, *keys: str) -> DataFrame:
    """keys, lse: ln of the sum of exp of each group's values, in one pass over the rows and without a join; no keys give one row.

    Values are summed by cells 512 wide, from the cell's middle; the highest cell and what the one below adds to it decide, any other is below 1e-200 of the sum.
    Nulls are left out. Where nothing but -inf, NaN or null is left, or no rows, the result is -inf; beside other values NaN makes it NaN, and so does inf.
    """
    x = _col(value).cast("double")
    finite = F.abs(x) < float("inf")  # NaN is greater than any number here
    cell = F.when(finite, F.rint(x / 512))
    cells = df.select(*keys, x.alias("_x"), cell.alias("_c")).groupBy(*keys, "_c").agg(
        F.sum(F.exp(F.col("_x") - 512 * F.col("_c"))).alias("_s"), F.coalesce(F.max(F.isnan("_x")), F.lit(False)).alias("_nan"), F.coalesce(F.max(F.col("_x") == float("inf")), F.lit(False)).alias("_inf"))
    pair = F.array(F.struct(F.col("_c").alias("_t"), F.col("_s").alias("_v"), F.lit(True).alias("_own")), F.struct((F.col("_c") + 1).alias("_t"), (F.col("_s") * F.exp(F.lit(-512.0))).alias("_v"), F.lit(False).alias("_own")))
    near = cells.select(*keys, "_nan", "_inf", F.explode(pair).alias("_p")).groupBy(*keys, F.col("_p._t").alias("_t")).agg(
        F.sum("_p._v").alias("_v"), F.max("_p._own").alias("_own"), F.max("_nan").alias("_nan"), F.max("_inf").alias("_inf"))
    top = F.max(F.when(F.col("_own") & F.col("_t").isNotNull(), F.struct("_t", "_v"))).alias("_top")
    found = near.groupBy(*keys).agg(top, F.coalesce(F.max("_nan"), F.lit(False)).alias("_nan"), F.coalesce(F.max("_inf"), F.lit(False)).alias("_inf"))
    lse = F.when(F.col("_top").isNull() & ~F.col("_inf"), float("-inf")).when(F.col("_nan") | F.col("_inf"), float("nan")).otherwise(F.log("_top._v") + 512 * F.col("_top._t"))
    return found.select(*keys, lse.alias("lse"))
