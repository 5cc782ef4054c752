"""Aggregates over event-time windows: those whose states merge exactly. Late rows past the watermark are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import descriptive as D
from quillon.operators.accum import bin_of


def _timed(stream: DataFrame, ts: str) -> DataFrame:
    """The event time as a timestamp of the session's zone; watermarks need one."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_moments(stream: DataFrame, ts: str, value: str, window: str, watermark: str, *keys: str) -> DataFrame:
    """window, keys, n, mean, var, lo and hi."""
    x = D.clean(value)
    grouped = _timed(stream, ts).withWatermark(ts, watermark).groupBy(F.window(ts, window), *keys)
    return grouped.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def windowed_histogram(stream: DataFrame, ts: str, value: str, window: str, watermark: str, lo: float, hi: float, bins: int, *keys: str) -> DataFrame:
    """window, keys, bin (-1 below, bins above) and n."""
    marked = _timed(stream, ts).withWatermark(ts, watermark).withColumn("bin", bin_of(value, lo, hi, bins)).where("bin IS NOT NULL")
    return marked.groupBy(F.window(ts, window), *keys, "bin").agg(F.count("*").alias("n"))
