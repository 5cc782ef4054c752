"""Exact sums of doubles in the JVM: an accumulator of integers, the same bits under any order and partitioning, without a Python worker.

A finite double is cut, without rounding, into three integers that count units of 2^(32 k), 2^(32 (k - 1)) and 2^(32 (k - 2)); k goes with its magnitude. Their upper
and lower 16 bits are summed as longs, which takes 2^46 rows of a group. A state is a row for each k that occurs, 66 of a group at most; it can be stored, and
rolled up by adding. At the end carries are passed on once and the number is rounded once, to nearest, ties to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.descriptive import clean, present
from quillon.operators.order import group_key
from quillon.operators.storage import dealt_join, stored

#: Values below 2^-400 are scaled by 2^640, which is 20 units of 32 bits, before they are cut.
_SMALL, _SCALE, _UNITS = 2.0**-400, 2.0**640, 20
#: Digits of 16 bits: the lowest that a value can have, four empty ones below it for rounding, and room for carries above the highest.
_LOWEST, _HIGHEST = -72 - 4, 63 + 6
_SUMS = tuple(f"_{part}{half}" for part in "abc" for half in "hl")


def _power(step: int, first: int, last: int, i: Column) -> Column:
    """2^(step i) for first <= i <= last, from a table: exact on any machine."""
    return F.element_at(F.lit([2.0 ** (step * j) for j in range(first, last + 1)]), (i - first + 1).cast("int"))


def _cut(rows: DataFrame) -> DataFrame:
    """_g, the count of values, and of a finite _x its _k and three integers; zeros have nulls there."""
    small = F.abs("_x") < _SMALL
    finite = (F.abs("_x") < float("inf")) & (F.col("_x") != 0)
    rows = rows.withColumn("_y", F.when(finite, F.when(small, F.col("_x") * _SCALE).otherwise(F.col("_x"))))
    rows = rows.withColumn("_k", F.least(F.floor(F.log2(F.abs("_y")) / 32), F.lit(31)).cast("long"))
    for name, below in (("_a", 0), ("_b", 1), ("_c", 2)):
        unit = _power(32, -16, 31, F.col("_k") - below)
        rows = rows.withColumn(name, (F.col("_y") / unit).cast("long")).withColumn("_y", F.col("_y") - F.col(name) * unit)
    return rows.withColumn("_k", F.when(small, F.col("_k") - _UNITS).otherwise(F.col("_k")))


def states(df: DataFrame, value: str | Column, *keys: str) -> DataFrame:
    """_g (a text for the group) and a row of sums for each _k that its values have; _odd is what the values that aren't finite add up to, else null."""
    rows = df.where(present(value)).select(group_key(keys).alias("_g"), clean(value).alias("_x"))
    return _states(rows, "_g")


def _states(rows: DataFrame, *by: str) -> DataFrame:
    halves = [f for c in ("_a", "_b", "_c") for f in (F.sum(F.shiftright(c, 16)).alias(f"{c}h"), F.sum(F.col(c).bitwiseAND(F.lit(65535))).alias(f"{c}l"))]
    return _cut(rows).groupBy(*by, "_k").agg(F.count("*").alias("_n"), F.sum(F.when(F.abs("_x") == float("inf"), F.col("_x"))).alias("_odd"), *halves)


def roll_up(parts: DataFrame) -> DataFrame:
    """States of several tables (or of finer groups whose _g was replaced) added up."""
    return parts.groupBy("_g", "_k").agg(F.sum("_n").alias("_n"), F.sum("_odd").alias("_odd"), *(F.sum(c).alias(c) for c in _SUMS))


def _rounded(digits: Column) -> Column:
    """The double nearest to the sum of v 2^(16 i) over an array of (i, v), i rising."""
    long = lambda n: F.lit(n).cast("long")
    carried = lambda carry, e, sign: e["v"] * sign + carry
    negative = F.aggregate(digits, long(0), lambda c, e: F.shiftright(carried(c, e, long(1)), 16)) < 0
    sign = F.when(negative, long(-1)).otherwise(long(1))

    def step(s: Column, e: Column) -> Column:
        v = carried(s["carry"], e, s["sign"])
        d = v.bitwiseAND(long(65535))
        low = F.shiftleft(s["w3"], 16) + s["w4"]
        low = F.when(s["rest"], low.bitwiseOR(long(1))).otherwise(low)
        seen = d != 0
        return F.struct(
            s["sign"].alias("sign"), F.shiftright(v, 16).alias("carry"), d.alias("w1"), s["w1"].alias("w2"), s["w2"].alias("w3"), s["w3"].alias("w4"), (s["rest"] | (s["w4"] != 0)).alias("rest"),
            F.when(seen, F.shiftleft(d, 32) + F.shiftleft(s["w1"], 16) + s["w2"]).otherwise(s["high"]).alias("high"), F.when(seen, low).otherwise(s["low"]).alias("low"), F.when(seen, e["i"] - 4).otherwise(s["at"]).alias("at"))

    start = F.struct(sign.alias("sign"), *(long(0).alias(c) for c in ("carry", "w1", "w2", "w3", "w4")), F.lit(False).alias("rest"), *(long(0).alias(c) for c in ("high", "low", "at")))

    def finish(s: Column) -> Column:
        # the top five digits hold 65 bits at least, their last one says whether anything is left below: one rounding, in the addition
        half = F.floor(s["at"] / 2)
        return s["sign"] * (s["high"] * F.lit(2.0**32) + s["low"]) * _power(16, -40, 40, half) * _power(16, -40, 40, s["at"] - half)

    return F.aggregate(digits, start, step, finish)


def finish(parts: DataFrame, *by: str) -> DataFrame:
    """The group (_g, or the columns by that the states have), n, sum: the correctly rounded sum of each group; infinite or NaN where values aren't finite, infinite where it overflows."""
    by = by or ("_g",)
    place = F.posexplode(F.array(*(F.coalesce(c, F.lit(0).cast("long")) for c in ("_cl", "_ch", "_bl", "_bh", "_al", "_ah"))))
    placed = parts.select(*by, F.coalesce("_k", F.lit(0).cast("long")).alias("_k"), "_n", "_odd", place.alias("_p", "_v"))
    first = F.col("_p") == 0
    digits = placed.groupBy(*by, (2 * (F.col("_k") - 2) + F.col("_p")).alias("i")).agg(F.sum("_v").alias("v"), F.sum(F.when(first, F.col("_n"))).alias("_n"), F.sum(F.when(first, F.col("_odd"))).alias("_odd"))
    whole = digits.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_odd").alias("_odd"), F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("_m"))  # 140 entries at most
    dense = F.transform(F.sequence(F.lit(_LOWEST).cast("long"), F.lit(_HIGHEST).cast("long")), lambda i: F.struct(i.alias("i"), F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0).cast("long")).alias("v")))
    return whole.select(*by, "n", F.coalesce("_odd", _rounded(dense)).alias("sum"))


def _keyed(found: DataFrame, df: DataFrame, keys: tuple[str, ...], *cols: str) -> DataFrame:
    if not keys:
        return found.select(*cols)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return found.withColumn("_k", F.from_json("_g", kinds)).select(*(F.col("_k")[k].alias(k) for k in keys), *cols)


def sums(df: DataFrame, value: str | Column, *keys: str) -> DataFrame:
    """keys, n, sum of each group that has values that aren't missing."""
    return _keyed(finish(states(df, value, *keys)), df, keys, "n", "sum")


def two_pass(df: DataFrame, value: str | Column, *keys: str) -> DataFrame:
    """keys, n, mean, var (n - 1): the variance from differences to the mean, which a first pass finds, less what the mean's rounding adds. Both passes sum exactly.

    var is null under two values, NaN where a value isn't finite. Rows find their mean by a join in which frequent groups are broadcast.
    """
    rows = df.where(present(value)).select(group_key(keys).alias("_g"), clean(value).alias("_x"))
    table = stored(finish(_states(rows, "_g")).select("_g", F.col("n").alias("_n"), (F.col("sum") / F.col("n")).alias("_mean")))
    d = F.col("_x") - F.col("_mean")
    pair = F.array(F.struct(F.lit(1).alias("_w"), d.alias("_x")), F.struct(F.lit(2).alias("_w"), (d * d).alias("_x")))
    line = dealt_join(rows, table, ["_g"], "_n").select("_g", F.explode(pair).alias("_e")).select("_g", "_e._w", "_e._x")
    found = finish(_states(line, "_g", "_w"), "_g", "_w")
    both = found.groupBy("_g").agg(F.max("n").alias("n"), F.max(F.when(F.col("_w") == 1, F.col("sum"))).alias("_d"), F.max(F.when(F.col("_w") == 2, F.col("sum"))).alias("_q"))
    done = both.join(table.select("_g", "_mean"), "_g")
    n = F.col("n")
    var = F.when(n > 1, F.greatest((F.col("_q") - F.col("_d") * F.col("_d") / n) / (n - 1), F.lit(0.0)))
    return _keyed(done.select("_g", "n", F.col("_mean").alias("mean"), var.alias("var")), df, keys, "n", "mean", "var")
