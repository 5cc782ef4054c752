"""Exact quantiles of groups of any size, all groups at once.

A quantile lies between two order statistics. Each has a bracket of values that must hold it, at first all values of its group. In every pass, Spark's approximate percentiles of the values in a
bracket, on a fixed grid, propose a narrower one, and an exact count of the values below and inside tells whether the order statistic is in it (if not, it lies in
what is left on that side). A pass is one aggregation with partial sums, and narrows by about GRID / 4; brackets that hold at most FEW values are finished:
their distinct values are counted and sorted, FEW rows for each at most. So no task holds the distinct values of a group, and the result is exact whatever the approximations are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.descriptive import clean, present
from quillon.operators.errors import ProbabilityOutOfRange
from quillon.operators.order import group_key
from quillon.operators.storage import stored

#: Values that a bracket may hold when it is finished.
FEW = 200_000
#: Cells of the grid of approximate percentiles.
GRID = 256
ACCURACY = 4096
#: Most groups whose brackets are broadcast; others are joined in a shuffle.
BROADCAST = 50_000
_INF = float("inf")


def _near(table: DataFrame, groups: int) -> DataFrame:
    return F.broadcast(table) if groups <= BROADCAST else table


def quantiles(df: DataFrame, value: str | Column, qs: list[float], *keys: str) -> DataFrame:
    """keys, n, and q: an array with the type-7 quantile of each q; groups without values that aren't missing have no row."""
    if not qs or not all(0 <= q <= 1 for q in qs):
        raise ProbabilityOutOfRange("quantiles need probabilities from 0 to 1")
    rows = df.where(present(value)).select(group_key(keys).alias("_g"), clean(value).alias("_x"))
    stats = stored(rows.groupBy("_g").agg(F.count("*").alias("n"), F.min("_x").alias("least"), F.max("_x").alias("most")))
    groups = stats.count()
    # the order statistics wanted, from 1: two for each q
    h = [F.lit(float(q)) * (F.col("n") - 1) for q in qs]
    ranks = F.array(*(F.struct(F.lit(2 * i + up).alias("t"), (F.ceil(x) if up else F.floor(x)).cast("long").alias("k")) for i, x in enumerate(h) for up in (0, 1)))
    wide = stats.select("_g", F.explode(ranks).alias("r"), F.col("n").alias("inside"), F.col("least").alias("lo"), F.col("most").alias("hi"))
    # below: how many values of the group lie under the bracket
    open_ = stored(wide.select("_g", "r.t", (F.col("r.k") + 1).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("below"), "inside"))
    done = None
    while True:
        small = (F.col("inside") <= FEW) | (F.col("lo") == F.col("hi"))
        ready, open_ = open_.where(small), open_.where(~small)
        done = ready if done is None else done.unionByName(ready)
        if open_.isEmpty():
            break
        open_ = stored(_narrowed(rows, open_, groups))
    found = _finished(rows, done, groups)
    by = found.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("m"))  # two values for each q
    at = lambda t: F.col("m")[F.lit(t)]

    def between(i: int) -> Column:
        a, b, f = at(2 * i), at(2 * i + 1), h[i] - F.floor(h[i])
        return F.when((f == 0) | (a == b), a).otherwise(a + f * (b - a))

    out = stats.join(_near(by, groups), "_g").select("_g", "n", F.array(*(between(i) for i in range(len(qs)))).alias("q"))
    if not keys:
        return out.drop("_g")
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return out.withColumn("_k", F.from_json("_g", kinds)).select(*(F.col("_k")[k].alias(k) for k in keys), "n", "q")


def _bracketed(rows: DataFrame, brackets: DataFrame, groups: int) -> DataFrame:
    """Every value with each bracket (_g, b, lo, hi) that holds it; brackets that are equal are one."""
    each = brackets.groupBy("_g").agg(F.collect_set(F.struct("lo", "hi")).alias("all"))  # at most two for each q
    inside = F.filter("all", lambda b: (F.col("_x") >= b["lo"]) & (F.col("_x") <= b["hi"]))
    return rows.join(_near(each, groups), "_g").withColumn("b", F.explode(inside))


def _narrowed(rows: DataFrame, open_: DataFrame, groups: int) -> DataFrame:
    """Narrower brackets of the same order statistics."""
    grid = [i / GRID for i in range(GRID + 1)]
    finite = F.when(F.abs("_x") < _INF, F.col("_x"))
    guesses = _bracketed(rows, open_, groups).groupBy("_g", "b").agg(F.percentile_approx(finite, grid, ACCURACY).alias("cells"))
    place = (F.col("k") - F.col("below") - 1) / F.greatest(F.col("inside") - 1, F.lit(1)) * GRID
    cell = lambda i: F.coalesce(F.element_at("cells", F.greatest(F.lit(1), F.least(F.lit(GRID + 1), i.cast("int")))), F.col("lo"))
    proposed = open_.join(guesses.select("_g", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"), "cells"), ["_g", "lo", "hi"])
    a, b = cell(F.floor(place) - 1 + 1), cell(F.ceil(place) + 1 + 1)
    proposed = proposed.withColumn("a", F.greatest("lo", F.least(a, b))).withColumn("b", F.least("hi", F.greatest(a, b))).withColumn("g", F.greatest("lo", F.least("hi", cell(F.round(place) + 1))))
    same = (F.col("a") <= F.col("lo")) & (F.col("b") >= F.col("hi"))  # no narrower: then one value, so that some are always cut off
    proposed = stored(proposed.select("_g", "t", "k", "lo", "hi", "below", "inside", F.when(same, F.col("g")).otherwise(F.col("a")).alias("a"), F.when(same, F.col("g")).otherwise(F.col("b")).alias("b")))
    # exact counts: under a, from a to b, and the neighbours of both beyond
    cuts = proposed.groupBy("_g").agg(F.collect_set(F.struct("lo", "hi", "a", "b")).alias("all"))
    x = F.col("_x")
    hits = rows.join(_near(cuts, groups), "_g").withColumn("c", F.explode(F.filter("all", lambda c: (F.col("_x") >= c["lo"]) & (F.col("_x") <= c["hi"]))))
    counts = hits.groupBy("_g", "c").agg(
        F.count_if(x < F.col("c.a")).alias("under"), F.count_if((x >= F.col("c.a")) & (x <= F.col("c.b"))).alias("within"), F.max(F.when(x < F.col("c.a"), x)).alias("before"), F.min(F.when(x > F.col("c.b"), x)).alias("after"))
    known = proposed.join(counts.select("_g", "c.*", "under", "within", "before", "after"), ["_g", "lo", "hi", "a", "b"])
    left, right = F.col("k") - F.col("below") <= F.col("under"), F.col("k") - F.col("below") > F.col("under") + F.col("within")
    pick = lambda l, r, m: F.when(left, l).when(right, r).otherwise(m)  # noqa: E731, E741
    return known.select(
        "_g", "t", "k", pick(F.col("lo"), F.col("after"), F.col("a")).alias("lo"), pick(F.col("before"), F.col("hi"), F.col("b")).alias("hi"),
        pick(F.col("below"), F.col("below") + F.col("under") + F.col("within"), F.col("below") + F.col("under")).alias("below"), pick(F.col("under"), F.col("inside") - F.col("under") - F.col("within"), F.col("within")).alias("inside"))


def _finished(rows: DataFrame, done: DataFrame, groups: int) -> DataFrame:
    """(_g, t, v): the order statistics, from brackets with few values or one."""
    done = stored(done)
    one = done.where("lo = hi").select("_g", "t", F.col("lo").alias("v"))
    more = done.where("lo <> hi")
    counts = _bracketed(rows, more, groups).groupBy("_g", "b", "_x").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("_g", "b").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = counts.withColumn("upto", F.sum("c").over(upto)).select("_g", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"), "_x", "c", "upto")  # at most FEW rows in a bracket
    place = F.col("k") - F.col("below")
    hit = sums.join(_near(more, groups), ["_g", "lo", "hi"]).where((place <= F.col("upto")) & (place > F.col("upto") - F.col("c")))
    return one.unionByName(hit.select("_g", "t", F.col("_x").alias("v")))
