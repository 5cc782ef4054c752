"""Permutation and bootstrap resampling. Draw b depends on the seed and b alone, so any split of the draws over tasks gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import rng
from quillon.operators.errors import DomainError, check_level

#: Values of a base sample that are broadcast at most.
LARGEST = 20_000_000


class Scheme(Enum):
    PERMUTATION = "permutation"
    BOOTSTRAP = "bootstrap"


class Sidedness(Enum):
    LESS = "less"
    GREATER = "greater"
    TWO_SIDED = "two_sided"


def resample_indices(scheme: Scheme, n: int, draw: int, seed: int) -> np.ndarray:
    """Row numbers of one draw: a Fisher-Yates shuffle, or n bounded integers."""
    if not 0 <= n < 1 << 32:
        raise DomainError("n must fit 32 bits")
    if scheme is Scheme.BOOTSTRAP:
        parts, got, at = [np.zeros(0, np.uint32)], 0, 0
        while got < n:  # as many words again as rows are lacking
            parts.append(rng.bounded_words(seed, draw, n, at, n - got))
            at, got = at + n - got, got + len(parts[-1])
        return np.concatenate(parts)
    out = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), rng.falling_bounds(seed, draw, n).tolist(), strict=True):
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.uint32)


def sign_flips(n: int, draw: int, seed: int) -> np.ndarray:
    """+1 or -1 for each row: bit i mod 32 of word i / 32 of the draw's sign stream."""
    w = rng.words(seed, np.array([draw], np.uint64), rng.STREAM_TAG_SIGNFLIP, -(-n // 32))[0]
    bits = (w[np.arange(n) // 32] >> (np.arange(n) % 32).astype(np.uint32)) & 1
    return 1.0 - 2.0 * bits


def draw_table(spark: SparkSession, scheme: Scheme, n: int, draws: int, seed: int, partitions: int = 8) -> DataFrame:
    """(draw, pos, row): the resampled rows of every draw."""

    def run(batches):
        for b in batches:
            for d in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d)), pa.array(np.arange(n)), pa.array(resample_indices(scheme, n, d, seed).astype(np.int64))], ["draw", "pos", "row"])

    return spark.range(0, draws, 1, partitions).mapInArrow(run, "draw long, pos long, row long")


def sign_table(spark: SparkSession, n: int, draws: int, seed: int, partitions: int = 8) -> DataFrame:
    """(draw, signs): an array of n signs for every draw."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sign_flips(n, d, seed) for d in ids], pa.list_(pa.float64()))], ["draw", "signs"])

    return spark.range(0, draws, 1, partitions).mapInArrow(run, "draw long, signs array<double>")


def run_draws(base: DataFrame, value: str, order: str, scheme: Scheme, draws: int, seed: int, statistic: Callable[[np.ndarray], float], partitions: int = 8, largest: int = LARGEST) -> DataFrame:
    """(draw, stat): statistic of each resampled sample. The base sample, ordered by a column, is broadcast; past the largest size it is refused."""
    n = base.count()
    if n > largest:
        raise DomainError(f"a base sample of {n} values isn't broadcast; bootstrap.resampled takes any size")
    x = base.select(F.col(value).cast("double").alias("x"), order).orderBy(order, "x").toArrow().column("x").to_numpy()
    shared = base.sparkSession.sparkContext.broadcast(x)

    def run(batches):
        own = shared.value
        for b in batches:
            got = [float(statistic(own[resample_indices(scheme, len(own), d, seed)])) for d in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["draw", "stat"])

    return base.sparkSession.range(0, draws, 1, partitions).mapInArrow(run, "draw long, stat double")


def null_p(stat: str | Column, observed: float | Column, side: Sidedness) -> Column:
    """The add-one p-value of an observed statistic among draws, as an aggregate."""
    s = F.col(stat) if isinstance(stat, str) else stat
    o = observed if isinstance(observed, Column) else F.lit(float(observed))
    extreme = {Sidedness.LESS: s <= o, Sidedness.GREATER: s >= o, Sidedness.TWO_SIDED: F.abs(s) >= F.abs(o)}[side]
    return (F.count_if(extreme) + 1) / (F.count("*") + 1)


def boot_interval(stat: str | Column, level: float) -> Column:
    """The percentile interval of draws (lower, upper), type 7, as an aggregate."""
    a = (1 - check_level(level)) / 2
    s = F.col(stat) if isinstance(stat, str) else stat
    return F.percentile(s, [a, 1 - a])
