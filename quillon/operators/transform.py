"""Ranks, normal scores, power transforms, probability transforms and quantile normalisation."""

from __future__ import annotations

from enum import Enum

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import special as S
from quillon.operators.descriptive import _col, clean, present
from quillon.operators.isotonic import monotone
from quillon.operators.order import ranked
from quillon.operators.storage import stored


class Ties(Enum):
    AVERAGE = "average"
    MIN = "min"
    MAX = "max"
    DENSE = "dense"
    ORDINAL = "ordinal"


class Infinities(Enum):
    AS_MISSING = "missing"
    AS_EXTREMES = "extremes"


def rank(df: DataFrame, value: str, ties: Ties, *keys: str, order: str | None = None, out: str = "rank") -> DataFrame:
    """Rows whose value isn't missing, with their rank (from 1) in their group. Ordinal ranks of ties go by the order column.

    Without keys, ranks are made over ranges (see order.ranked, which also takes keys whose groups outgrow a task).
    """
    if ties is Ties.ORDINAL and order is None:
        raise ValueError("ordinal ranks need an order column")
    if not keys:
        return ranked(df, value, ties.value, order=order, out=out)
    x = F.col("_x")
    w = Window.partitionBy(*keys).orderBy(x)
    r = {
        Ties.MIN: lambda: F.rank().over(w),
        Ties.DENSE: lambda: F.dense_rank().over(w),
        Ties.ORDINAL: lambda: F.row_number().over(w.orderBy(x, order)),
        Ties.MAX: lambda: F.count("*").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        Ties.AVERAGE: lambda: F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, "_x")) - 1) / 2,
    }[ties]()
    return df.where(present(value)).withColumn("_x", clean(value)).withColumn(out, r.cast("double")).drop("_x")


def normal_scores(df: DataFrame, value: str, *keys: str, out: str = "score") -> DataFrame:
    """Blom's scores: the normal quantile of (rank - 3/8) / (n + 1/4)."""
    r = rank(df, value, Ties.AVERAGE, *keys, out="_r")
    r = r.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)) if keys else F.lit(df.where(present(value)).count()))
    return r.withColumn(out, S.column(S.norm_ppf, (F.col("_r") - 0.375) / (F.col("_n") + 0.25))).drop("_r", "_n")


def box_cox(x: str | Column, lam: float) -> Column:
    """(x^l - 1) / l, or ln x; a value that isn't positive fails the query."""
    x = clean(x)
    y = F.log(x) if lam == 0 else (F.pow(x, F.lit(float(lam))) - 1) / lam
    return F.when(x > 0, y).when(x <= 0, F.raise_error(F.lit("box_cox needs positive values")).cast("double"))


def yeo_johnson(x: str | Column, lam: float) -> Column:
    """Yeo and Johnson's four branches by the signs of the value and of the exponent."""
    x = clean(x)
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(float(lam))) - 1) / lam
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2.0 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).when(x < 0, down)


def pit(x: str | Column, dist) -> Column:
    """dist.cdf(x)."""
    return dist.cdf(_col(x))


def inv_pit(u: str | Column, dist) -> Column:
    """dist.quantile(u)."""
    return dist.quantile(_col(u))


def quantile_map(x: str | Column, source, target) -> Column:
    """target.quantile(source.cdf(x)), in one function; between continuous distributions, upper tails go by sf and isf, since their cdf rounds to 1."""
    a, b = source.numpy, target.numpy
    if source.discrete or target.discrete:
        return S.column(lambda v: b.quantile(a.cdf(v)), _col(x))

    def mapped(v):
        u = a.cdf(v)
        return np.where(u > 0.5, b.isf(a.sf(v)), b.quantile(u))

    return S.column(mapped, _col(x))


def quantile_normalize(df: DataFrame, col: str, row: str, value: str, infinities: Infinities = Infinities.AS_MISSING) -> DataFrame:
    """(col, row, value) with every column given the same distribution: the mean of the sorted columns (Bolstad et al. 2003).

    A column with missing entries spreads its m observed values over the n places, one value over all; missing entries stay in place. As extremes, infinities take
    part in the ranks of their column, stay in place, and are left out of the means. Means run over places, as a table of n rows, made monotone
    in windows where columns are incomplete or hold infinities; where no place has a finite value, results are NaN.
    """
    x = F.col(value).cast("double")
    seen = present(value) & ((F.abs(x) != float("inf")) if infinities is Infinities.AS_MISSING else F.lit(True))
    n = df.select(row).distinct().count()
    ok = df.where(seen).select(F.col(col), F.col(row), x.alias("_x"))
    by = Window.partitionBy(col)
    ranked = ok.withColumn("_i", F.row_number().over(by.orderBy("_x", row)) - 1).withColumn("_m", F.count("*").over(by))
    ranked = ranked.withColumn("_r", F.rank().over(by.orderBy("_x")) - 1 + (F.count("*").over(Window.partitionBy(col, "_x")) - 1) / 2)
    ranked = stored(ranked)
    # the place of the i-th of m values among n places
    place = F.when(F.col("_m") > 1, F.col("_i") * (n - 1) / F.nullif(F.col("_m") - 1, F.lit(0))).otherwise(F.lit((n - 1) / 2.0))
    infinite = F.abs("_x") == float("inf")
    complete = ranked.where((F.col("_m") < n) | infinite).isEmpty()
    if complete:
        target = ranked.groupBy(F.col("_i").alias("_at")).agg(F.avg("_x").alias("_t"))
    else:
        nxt = F.lead("_x").over(by.orderBy("_i"))
        nxt_place = F.lead("_p").over(by.orderBy("_i"))
        pieces = ranked.withColumn("_p", place).withColumn("_x2", nxt).withColumn("_p2", nxt_place)
        alone = F.col("_m") == 1
        first = F.when(alone, 0).otherwise(F.ceil("_p")).cast("long")
        last = F.when(alone, n - 1).when(F.col("_p2").isNull(), F.floor("_p")).otherwise(F.ceil("_p2") - 1).cast("long")
        filled = pieces.withColumn("_first", first).withColumn("_last", last).where("_first <= _last").withColumn("_at", F.explode(F.sequence("_first", "_last")))
        y = F.when(alone | (F.col("_at") == F.col("_p")), F.col("_x")).otherwise(F.col("_x") + (F.col("_x2") - F.col("_x")) * (F.col("_at") - F.col("_p")) / (F.col("_p2") - F.col("_p")))
        sums = filled.withColumn("_y", y).where(~F.isnan("_y") & (F.abs("_y") < float("inf"))).groupBy(F.col("_at").alias("at")).agg(F.sum("_y").alias("s"), F.count("*").alias("c"))
        target = stored(monotone(sums, n).select(F.col("at").alias("_at"), F.col("fitted").alias("_t")))
    back = F.when(F.col("_m") > 1, F.col("_r") * (n - 1) / F.nullif(F.col("_m") - 1, F.lit(0))).otherwise(F.lit((n - 1) / 2.0))
    spots = ranked.withColumn("_b", back).withColumn("_lo", F.floor("_b").cast("long")).withColumn("_hi", F.ceil("_b").cast("long"))
    lo, hi = target.select(F.col("_at").cast("long").alias("_lo"), F.col("_t").alias("_tl")), target.select(F.col("_at").cast("long").alias("_hi"), F.col("_t").alias("_th"))
    f = F.col("_b") - F.col("_lo")
    mapped = spots.join(lo, "_lo").join(hi, "_hi").select(col, row, (F.when(f == 0.5, (F.col("_tl") + F.col("_th")) / 2).otherwise(F.col("_tl") + f * (F.col("_th") - F.col("_tl")))).alias("_new"))
    return df.join(mapped, [col, row], "left").select(col, row, F.when(seen & (F.abs(x) < float("inf")), F.col("_new")).otherwise(x).alias(value))
