"""Permutation inference on tables: data of any size, and nulls that grow by merging.

The data, long rows (subject, node, value), become a stored table of residual blocks: some nodes x all rows, at most CELLS numbers each. Draws are multiplied with a block where it
lies; no block is sent twice and no matrix meets on the driver. The pieces of a map are gathered by draw, one map at a time, for enhancement. A
null is two tables under one path, (draw, max) and (node, exceed), in one folder for each run of draws; a run is part of the null once its line in the table of runs is written. A later call
computes only the draws that are missing. p-values are made by Spark aggregates and ranks; what the driver holds is the design (a few columns of
one number for each subject), the graph and the observed map.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.graph import Domain, NeuroError
from quillon.operators.order import value_ranks
from quillon.operators.permute import Design, PermOpts, complete_rows, t_values
from quillon.operators.storage import shared_dir, stored
from quillon.operators.tfce import INFERENCE, InvalidParams, Tail, TfceParams, checked_broadcast, resolve_params, tfce_map

#: Most numbers of a block.
CELLS = 1 << 20
#: Most subjects: their design lies on the driver.
SUBJECTS = 1 << 20
#: Draws that are multiplied with a block at once.
AT_ONCE = 64


def subject_rows(df: DataFrame) -> list:
    """The subjects, in order."""
    found = [r[0] for r in df.select("subject").distinct().limit(SUBJECTS + 1).collect()]
    if len(found) > SUBJECTS:
        raise NeuroError(f"more than {SUBJECTS} subjects")
    if None in found:
        raise NeuroError("a subject is null")
    return sorted(found)


def block_store(df: DataFrame, design: Design, subjects: list, n_nodes: int, single: bool = False, width: int | None = None) -> DataFrame:
    """(first, cells) of every block, stored: the first node, and the residuals [row, node] as bytes of float64, or of float32 where single.

    Rows of other subjects are left out; every subject must have one finite value at every node.
    """
    n = design.n
    width = max(1, min(width or CELLS // n, n_nodes))
    kind = np.float32 if single else np.float64
    names = df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(subjects)], f"subject {df.schema['subject'].dataType.simpleString()}, row long")
    ready = df.join(F.broadcast(names), "subject").select("row", F.col("node").cast("long").alias("node"), F.col("value").cast("double").alias("value"))  # at most SUBJECTS rows
    ready = ready.withColumn("first", F.col("node") - F.pmod("node", F.lit(width)))

    def run(t: pa.Table) -> pa.Table:
        first = t.column("first")[0].as_py()
        size = min(width, n_nodes - first)
        y = np.full((n, max(size, 0)), np.nan)
        if first < 0 or size <= 0 or t.num_rows != n * size or int(np.max(t.column("node").to_numpy())) >= n_nodes:
            raise NeuroError(f"needs one value for each of {n} rows and {n_nodes} nodes")
        y[t.column("row").to_numpy(), t.column("node").to_numpy() - first] = t.column("value").to_numpy()
        if not np.isfinite(y).all():
            raise NeuroError("data must be finite, one value for each row and node")
        return pa.table({"first": [first], "cells": pa.array([design.residuals(y).astype(kind).tobytes()], pa.binary())})

    blocks = stored(ready.groupBy("first").applyInArrow(run, "first long, cells binary"))
    if blocks.count() != -(-n_nodes // width):
        raise NeuroError(f"needs a value at each of {n_nodes} nodes")
    return blocks


def products(blocks: DataFrame, design: Design, first: int, last: int, single: bool = False) -> DataFrame:
    """(draw, first, stats): the t statistics (bytes of float64) of the block that begins at node first, for the draws from first up to last."""
    shared = blocks.sparkSession.sparkContext.broadcast(design)
    kind = np.float32 if single else np.float64

    def run(batches):
        own = shared.value
        for b in batches:
            for node, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r = np.frombuffer(cells, kind).reshape(own.n, -1).astype(float)
                for at in range(first, last, AT_ONCE):
                    draws = range(at, min(at + AT_ONCE, last))
                    stats = [t_values(own.rearranged(d), r, own.dof).tobytes() for d in draws]
                    yield pa.RecordBatch.from_arrays([pa.array(draws, pa.int64()), pa.array([node] * len(draws), pa.int64()), pa.array(stats, pa.binary())], ["draw", "first", "stats"])

    n = max(1, min(blocks.count(), 4 * blocks.sparkSession.sparkContext.defaultParallelism))
    return blocks.repartitionByRange(n, "first").mapInArrow(run, "draw long, first long, stats binary")


def _assembled(batches, n_nodes: int):
    """(draw, map) of rows sorted by draw and first node."""
    draw, parts = None, []
    for b in batches:
        for d, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if d != draw and parts:
                yield draw, np.frombuffer(b"".join(parts))
                parts = []
            draw = d
            parts.append(s)
    if parts:
        m = np.frombuffer(b"".join(parts))
        if len(m) != n_nodes:
            raise NeuroError(f"a map has {len(m)} of {n_nodes} nodes")
        yield draw, m


def _gathered(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("draw").sortWithinPartitions("draw", "first")


def observed(blocks: DataFrame, design: Design, domain: Domain, params: TfceParams, tail: Tail, single: bool = False) -> DataFrame:
    """(node, stat, tfce) of draw 0, stored."""
    shared = checked_broadcast(blocks.sparkSession, domain)

    def run(batches):
        for _, m in _assembled(batches, shared.value.n):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(m))), pa.array(m), pa.array(tfce_map(shared.value, m, params, tail))], ["node", "stat", "tfce"])

    return stored(_gathered(products(blocks, design, 0, 1, single)).mapInArrow(run, "node long, stat double, tfce double"))


def null_run(blocks: DataFrame, design: Design, domain: Domain, params: TfceParams, tail: Tail, height: np.ndarray, first: int, last: int, single: bool = False) -> DataFrame:
    """Rows (draw, max) of the draws from first up to last, and rows (node, exceed): how often a node's enhanced value reaches its height, summed over the draws of a task."""
    spark = blocks.sparkSession
    graph, level = checked_broadcast(spark, domain), spark.sparkContext.broadcast(height)
    names = ["draw", "max", "node", "exceed"]

    def run(batches):
        exceed = np.zeros(graph.value.n, np.int64)
        draws, tops = [], []
        for d, m in _assembled(batches, graph.value.n):
            t = tfce_map(graph.value, m, params, tail)
            t = np.abs(t) if tail is Tail.TWO_SIDED else t
            draws.append(d)
            tops.append(max(0.0, float(t.max(initial=0.0))))
            exceed += t >= level.value
        none = lambda k, kind: pa.nulls(k, kind)
        if draws:
            k, v = len(draws), len(exceed)
            yield pa.RecordBatch.from_arrays([pa.array(draws, pa.int64()), pa.array(tops, pa.float64()), none(k, pa.int64()), none(k, pa.int64())], names)
            yield pa.RecordBatch.from_arrays([none(v, pa.int64()), none(v, pa.float64()), pa.array(np.arange(v)), pa.array(exceed)], names)

    return _gathered(products(blocks, design, first, last, single)).mapInArrow(run, "draw long, max double, node long, exceed long")


class Null:
    """The stored null of a test: runs of draws under one path."""

    def __init__(self, spark: SparkSession, path: str, settings: dict) -> None:
        self.spark, self.path, self.settings = spark, path.rstrip("/"), json.dumps(settings, sort_keys=True)

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def runs(self) -> list[tuple[int, int]]:
        """The finished runs (first, last), in order; an error if they belong to another test."""
        if not self._exists("runs"):
            return []
        rows = self.spark.read.parquet(f"{self.path}/runs").collect()  # one row for each call
        if any(r.settings != self.settings for r in rows):
            raise InvalidParams("the stored null is of another test")
        return sorted((r.first, r.last) for r in rows)

    @property
    def draws(self) -> int:
        """How many draws, from 0, are there."""
        return self.runs()[-1][1] if self.runs() else 0

    def add(self, run: DataFrame, first: int, last: int) -> None:
        """Store the rows of null_run for draws that follow those that are there."""
        if first != self.draws or last <= first:
            raise InvalidParams(f"the next draw is {self.draws}, not {first}")
        run.write.mode("overwrite").parquet(f"{self.path}/draws_{first}_{last}")
        self.spark.createDataFrame([(first, last, self.settings)], "first long, last long, settings string").coalesce(1).write.mode("append").parquet(f"{self.path}/runs")

    def rows(self) -> DataFrame:
        """All rows of all finished runs."""
        return self.spark.read.schema("draw long, max double, node long, exceed long").parquet(*(f"{self.path}/draws_{a}_{b}" for a, b in self.runs()))

    def maxima(self) -> DataFrame:
        """(draw, max)."""
        return self.rows().where("draw IS NOT NULL").select("draw", "max")

    def exceed(self) -> DataFrame:
        """(node, exceed) over all runs."""
        return self.rows().where("node IS NOT NULL").groupBy("node").agg(F.sum("exceed").alias("exceed"))


def p_values(obs: DataFrame, maxima: DataFrame, exceed: DataFrame, draws: int, tail: Tail) -> DataFrame:
    """(node, stat, tfce, p_fwe, p_unc): the shares of draws whose maximum, or whose value at the node, reaches the observed one.

    Maxima below a height are counted by ranks: its least rank among heights and maxima less that among heights alone.
    """
    height = F.abs("tfce") if tail is Tail.TWO_SIDED else F.col("tfce")
    heights = obs.select("node", height.alias("h"))
    both = value_ranks(heights.select("h").union(maxima.select("max")), "h").select(F.col("_x").alias("h"), F.col("lowest").alias("among_both"))
    alone = value_ranks(heights, "h").select(F.col("_x").alias("h"), F.col("lowest").alias("among_heights"))
    below = alone.join(both, "h").select("h", (F.col("among_both") - F.col("among_heights")).alias("below"))
    done = obs.withColumn("h", height).join(below, "h").join(exceed, "node")
    return done.select("node", "stat", "tfce", ((F.lit(draws) - F.col("below")) / F.lit(draws)).alias("p_fwe"), (F.col("exceed") / F.lit(draws)).alias("p_unc"))


def inference(df: DataFrame, domain: Domain, *, tested=None, confounds=None, params="exact", tail: Tail | str = Tail.TWO_SIDED, seed: int = 0, n_perm: int = 10_000, path: str | None = None, single: bool = False, width: int | None = None) -> tuple[DataFrame, Null]:
    """(node, stat, tfce, p_fwe, p_unc) of long rows (subject, node, value), and the null. tested and confounds have a row for each subject, in order.

    With a path, the null is stored there, and draws that it holds already aren't run again; the number of draws may grow from call to call. An enumerated null can't grow.
    """
    spark = df.sparkSession
    tail = tail if isinstance(tail, Tail) else Tail(tail)
    opts = PermOpts(resolve_params(params, INFERENCE), tail, seed, n_perm)
    subjects = subject_rows(df)
    keep = complete_rows(len(subjects), tested, confounds)
    pick = lambda c: None if c is None else np.asarray(c, float)[keep]
    design = Design(len(keep), pick(tested), pick(confounds), opts)
    blocks = block_store(df, design, [subjects[i] for i in keep], domain.n, single, width)
    obs = observed(blocks, design, domain, opts.params, tail, single)
    values = obs.orderBy("node").select("tfce").toArrow().column(0).to_numpy()  # the observed map, a number for each node of the graph
    height = np.abs(values) if tail is Tail.TWO_SIDED else values
    settings = {"seed": seed, "tail": tail.value, "n": design.n, "q": design.q, "enumerated": design.exact, "single": single, "params": asdict(opts.params) | {"weighting": opts.params.weighting.value}, "observed": hashlib.sha256(values.tobytes()).hexdigest()}
    null = Null(spark, path or f"{shared_dir(spark).rstrip('/')}/null_{uuid.uuid4().hex}", settings)
    have = null.draws
    if have > design.draws:
        raise InvalidParams(f"the stored null has {have} draws already")
    if have < design.draws:
        null.add(null_run(blocks, design, domain, opts.params, tail, height, have, design.draws, single), have, design.draws)
    return p_values(obs, null.maxima(), null.exceed(), design.draws, tail), null
