"""Monotone means of a table of places, of any size.

Neighbouring places whose means fall are pooled until the means of the pools rise. The outcome doesn't depend on the order of pooling, so
the table is cut into windows of WINDOW pools that follow each other, each is pooled in a task of its own, and the next pass cuts them half a window
further, where the borders of the pass before lie inside. It ends when no mean falls across a border. Pools are numbered anew in every
pass, by a count of each stretch of places and the running sum of these counts, so a window never holds more than WINDOW pools. What meets in
one task is a row for each window or stretch, never one for each place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.storage import stored

#: Pools of a window and places of a stretch, at most.
WINDOW = 200_000
_POOLS = "w long, first long, last long, s double, c double"


def pool(s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and weights pooled until their means rise, and how many entries each pool has."""
    blocks: list[list[float]] = []
    for total, weight in zip(s.tolist(), c.tolist(), strict=True):
        blocks.append([total, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            s1, c1, m = blocks.pop()
            blocks[-1][0] += s1
            blocks[-1][1] += c1
            blocks[-1][2] += m
    made = np.array(blocks).reshape(-1, 3)
    return made[:, 0], made[:, 1], made[:, 2].astype(np.int64)


def _pool_window(key: tuple, t: pa.Table) -> pa.Table:
    t = t.sort_by("first")
    first, last = t.column("first").to_numpy(), t.column("last").to_numpy()
    s, c, members = pool(t.column("s").to_numpy(), t.column("c").to_numpy())
    end = np.cumsum(members)
    return pa.table({"w": pa.array([key[0].as_py()] * len(s), pa.int64()), "first": first[end - members], "last": last[end - 1], "s": s, "c": c})


def _numbered(pools: DataFrame, window: int) -> DataFrame:
    """pools with _i, their number from 0 in the order of places."""
    cut = pools.withColumn("_z", F.floor(F.col("first") / window))
    sizes = cut.groupBy("_z").agg(F.count("*").alias("_n"))
    before = sizes.select("_z", (F.sum("_n").over(Window.orderBy("_z")) - F.col("_n")).alias("_before"))  # a row for each stretch
    return cut.join(before, "_z").withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_z").orderBy("first")) - 1)


def _borders(pools: DataFrame) -> DataFrame:
    """For each window (w) the first place and the means at both ends, and those of the window that follows."""
    mean = F.col("s") / F.col("c")
    ends = pools.groupBy("w").agg(F.min("first").alias("start"), F.min_by(mean, "first").alias("head"), F.max_by(mean, "first").alias("tail"))
    order = Window.orderBy("w")  # a row for each window
    return ends.select("w", "tail", F.lead("start").over(order).alias("next_start"), F.lead("head").over(order).alias("next_head"))


def pools(sums: DataFrame, window: int | None = None) -> DataFrame:
    """(w, first, last, s, c): the pools of a table (at, s, c) with one row for each place, its sum s and its weight c > 0; w numbers the last pass's windows."""
    window = window or WINDOW
    got = sums.select(F.col("at").cast("long").alias("first"), F.col("at").cast("long").alias("last"), F.col("s").cast("double").alias("s"), F.col("c").cast("double").alias("c"))
    half = 0
    while True:
        cut = _numbered(got, window).select(F.floor((F.col("_i") + half) / window).alias("w"), "first", "last", "s", "c")
        got = stored(cut.groupBy("w").applyInArrow(_pool_window, _POOLS))
        if _borders(got).where("tail > next_head").isEmpty():
            return got
        half = window // 2 - half


def monotone(sums: DataFrame, n: int, window: int | None = None) -> DataFrame:
    """(at, fitted) for every place from 0 to n - 1: the non-decreasing means nearest to those of sums (see pools) in weighted squares.

    Places without a row are filled linearly from the two pools around them, and take the nearest pool's mean before the first and after the last; without
    any row all are NaN. Means must be finite.
    """
    window = window or WINDOW
    done = pools(sums, window)
    if done.isEmpty():
        return sums.sparkSession.range(n).select(F.col("id").alias("at"), F.lit(float("nan")).alias("fitted"))
    own = Window.partitionBy("w").orderBy("first")
    mean = F.col("s") / F.col("c")
    linked = done.join(_borders(done), "w").select(
        "first", "last", mean.alias("mean"), F.coalesce(F.lead("first").over(own), "next_start").alias("then"), F.coalesce(F.lead(mean).over(own), "next_head").alias("then_mean"))
    least = done.agg(F.min("first")).first()[0]
    # a pool covers the places up to the next one; the first also those before it, the last also those behind it
    lo = F.when(F.col("first") == least, F.lit(0)).otherwise(F.col("first"))
    reach = F.sequence(F.floor(lo / window), F.floor(F.coalesce("then", F.lit(n - 1)) / window))

    def fill(key: tuple, t: pa.Table) -> pa.Table:
        z = key[0].as_py()
        known = t.column("then").is_valid().to_numpy()
        first, last, then, level, then_level = (t.column(x).to_numpy() for x in ("first", "last", "then", "mean", "then_mean"))
        x, at = np.unique(np.concatenate([first, last, then[known].astype(np.int64)]), return_index=True)
        y = np.concatenate([level, level, then_level[known]])[at]
        places = np.arange(z * window, min(n, (z + 1) * window))
        return pa.table({"at": pa.array(places), "fitted": pa.array(np.interp(places, x, y))})

    return linked.withColumn("z", F.explode(reach)).groupBy("z").applyInArrow(fill, "at long, fitted double")
