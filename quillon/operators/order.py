"""Global order: ranks of rows in groups of any size, without a window that gathers a group in one task.

Distinct values are counted, dealt out by ranges and sorted; each range sums its counts, and the ranges' totals (a row for each range and group) are added up before it. So a group is
spread over as many tasks as it needs, a tie of any size is one row of counts, and ties never cross a range. Ordinal ranks sort the rows
themselves by value and order column. Names of helper columns start with an underscore.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.descriptive import clean, present
from quillon.operators.storage import dealt_join, stored

#: monotonically_increasing_id() holds the partition above these bits, and the place in it below.
_PLACE_BITS = 33


def group_key(keys: tuple[str, ...]) -> Column:
    """One text for a group; nulls are a group like any other."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")


def _summed(batches):
    """Of a sorted partition of (g, x, n): the same with the partition, and what stands before the row in its group within the partition: rows and values."""
    from pyspark import TaskContext

    part, last, rows, values = TaskContext.get().partitionId(), None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(0).dictionary_encode()
        codes, n = g.indices.to_numpy(), b.column(2).to_numpy()
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        sizes = np.diff(np.append(first, len(codes)))
        upto = np.cumsum(n) - n
        before, place = upto - np.repeat(upto[first], sizes), np.arange(len(n)) - np.repeat(first, sizes)
        if g.dictionary[codes[0]].as_py() == last:  # the group of the batch before goes on
            before[: sizes[0]] += rows
            place[: sizes[0]] += values
        last, rows, values = g.dictionary[codes[-1]].as_py(), int(before[-1] + n[-1]), int(place[-1] + 1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part)), pa.array(before), pa.array(place)], ["_g", "_x", "n", "_part", "before", "place"])


def _offsets(parts: DataFrame, *sums: str) -> DataFrame:
    """(g, part) rows with running sums of what stands in the parts before; a group has a row for each of its ranges."""
    upto = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_g", "_part", *(F.coalesce(F.sum(s).over(upto), F.lit(0)).alias(f"{s}_off") for s in sums))


def value_ranks(df: DataFrame, value: str | Column, *keys: str) -> DataFrame:
    """(g, x, n, lowest, dense) of every distinct value that isn't missing: how often it stands in its group, and its ranks from 1."""
    counts = df.where(present(value)).groupBy(group_key(keys).alias("_g"), clean(value).alias("_x")).agg(F.count("*").alias("n"))
    dealt = counts.repartitionByRange("_g", "_x").sortWithinPartitions("_g", "_x")
    runs = stored(dealt.mapInArrow(_summed, "_g string, _x double, n long, _part long, before long, place long"))
    offsets = _offsets(runs.groupBy("_g", "_part").agg(F.sum("n").alias("rows"), F.count("*").alias("values")), "rows", "values")
    placed = dealt_join(runs, offsets.join(runs.groupBy("_g", "_part").agg(F.count("*").alias("here")), ["_g", "_part"]), ["_g", "_part"], "here")
    return placed.select("_g", "_x", "n", (F.col("before") + F.col("rows_off") + 1).alias("lowest"), (F.col("place") + F.col("values_off") + 1).alias("dense"))


def ranked(df: DataFrame, value: str, ties: str, *keys: str, order: str | None = None, out: str = "rank") -> DataFrame:
    """Rows whose value isn't missing, with their rank (from 1, a double) in their group. ties: average, min, max, dense, or ordinal (by the order column)."""
    rows = df.where(present(value)).withColumn("_g", group_key(keys)).withColumn("_x", clean(value))
    if ties == "ordinal":
        return _ordinal(rows, (order,), out).drop("_g", "_x")
    table = stored(value_ranks(df, value, *keys))
    r = {"min": F.col("lowest"), "max": F.col("lowest") + F.col("n") - 1, "dense": F.col("dense"), "average": F.col("lowest") + (F.col("n") - 1) / 2}[ties]
    table = table.select("_g", "_x", F.col("n").alias("_n"), r.cast("double").alias("_rank"))
    return dealt_join(rows, table, ["_g", "_x"], "_n").select(*(c for c in df.columns if c != out), F.col("_rank").alias(out))


def _ordinal(rows: DataFrame, order: tuple[str, ...], out: str) -> DataFrame:
    """The rows sorted by group, value and order columns, numbered from 1 in each group."""
    dealt = rows.repartitionByRange("_g", "_x", *order).sortWithinPartitions("_g", "_x", *order)
    numbered = stored(dealt.withColumn("_id", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_part", F.shiftright("_id", _PLACE_BITS)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    parts = numbered.groupBy("_g", "_part").agg(F.count("*").alias("rows"), F.min("_at").alias("_first"))
    table = _offsets(parts, "rows").join(parts, ["_g", "_part"])
    done = dealt_join(numbered, table, ["_g", "_part"], "rows")
    return done.withColumn(out, (F.col("_at") - F.col("_first") + F.col("rows_off") + 1).cast("double")).drop("_part", "_id", "_at", "_first", "rows", "rows_off")


def numbered(df: DataFrame, *by: str, out: str = "row") -> DataFrame:
    """All rows, numbered from 0 in the order of some columns (nulls first), which should tell rows apart: equal ones are numbered in any order, and lie in one range."""
    rows = df.withColumn("_g", F.lit("")).withColumn("_x", F.lit(0.0))
    done = _ordinal(rows, by, "_row").drop("_g", "_x")
    return done.select(*(c for c in df.columns if c != out), (F.col("_row") - 1).cast("long").alias(out))
