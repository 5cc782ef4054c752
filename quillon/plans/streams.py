"""Queries of the streaming aggregates, run to their end over a bounded source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.operators import accum
from quillon.operators.storage import shared_dir
from quillon.plans.descriptive import rounded
from quillon.plans.register import Register
from quillon.streaming import digests, windows

query = Register()
QUERIES, ORACLES = query.queries, query.oracles


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drained(spark, frame, mode: str = "complete"):
    name = f"drained_{uuid.uuid4().hex[:12]}"
    where = shared_dir(spark)
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{where.rstrip('/')}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("stream_windowed_moments", """
    SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 5) AS var, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL""")
def stream_windowed_moments(spark, sf_dir):
    out = _drained(spark, windows.windowed_moments(_stream(spark, sf_dir), "ts", "value", "1 day", "2 days", "event_type"))
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"), F.round("var", 5).alias("var"), "lo", "hi")


@query("stream_windowed_histogram", """
    SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, CASE WHEN value < 0 THEN -1 WHEN value > 200 THEN 10 ELSE least(floor(value / 20.0), 9) END::INT AS bin, count(*) AS n FROM events GROUP BY ALL""")
def stream_windowed_histogram(spark, sf_dir):
    out = _drained(spark, windows.windowed_histogram(_stream(spark, sf_dir), "ts", "value", "7 days", "14 days", 0.0, 200.0, 10))
    return rounded(out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "bin", "n"))


def delivered(spark, sf_dir, path: str, files: int = 4):
    """The events in four deliveries of a few files each: by thirds of the time, but every tenth event of the first third comes last, when its windows have closed. A stream that takes one delivery a batch."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = events.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    third = F.floor(3 * (at - F.col("lo")) / (F.col("hi") - F.col("lo") + 1))
    late = (F.col("third") == 0) & (F.col("event_id") % 10 == 0)
    dealt = events.join(F.broadcast(ends)).withColumn("third", third).withColumn("delivery", F.when(late, 3).otherwise(F.col("third")))  # one row of ends
    for k in range(4):
        dealt.where(F.col("delivery") == k).select(events.columns).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path), dealt.where("delivery < 3").select(events.columns)


@query("stream_digests", """
    WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
    e AS (SELECT event_type, ts, value, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start FROM events, b WHERE NOT (floor(3 * (epoch_us(ts) - lo) / (hi - lo + 1)::DOUBLE) = 0 AND event_id % 10 = 0))
    SELECT event_type, start, count(value) AS n, min(value) AS lo, max(value) AS hi, true AS within FROM e, b WHERE value IS NOT NULL AND epoch_us(start) + 86400000000 <= b.hi - 2 * 86400000000 GROUP BY event_type, start""")
def stream_digests(spark, sf_dir):
    """Closed windows in append mode; late rows are in none of them. within: the digest's median has a rank within 0.75 % (and two values) of a half."""
    digests.prepare(spark)
    stream, kept = delivered(spark, sf_dir, f"{shared_dir(spark).rstrip('/')}/delivered_{uuid.uuid4().hex[:12]}")
    out = _drained(spark, digests.windowed_digest(stream, "ts", "value", "1 DAY", "2 days", "event_type"), "append")
    flat = out.select("event_type", "start", "digest.n", F.col("digest.least").alias("lo"), F.col("digest.most").alias("hi"), accum.tdigest_quantile("digest", 0.5).alias("median"))
    ranks = kept.where("value IS NOT NULL").withColumn("start", F.date_trunc("day", F.col("ts").cast("timestamp"))).join(flat, ["event_type", "start"])
    share = ranks.groupBy("event_type", "start", "n", "lo", "hi").agg(F.avg((F.col("value") <= F.col("median")).cast("double")).alias("share"))
    return share.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", "lo", "hi", (F.abs(F.col("share") - 0.5) <= 0.0075 + 2 / F.col("n")).alias("within"))
