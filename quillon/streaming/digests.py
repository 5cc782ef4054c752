"""t-digests of event-time windows, as state of a stream, given out once when a window has closed.

The state of a group and window is a digest; its timer is the window's end. When the watermark passes that, the digest is given out and the state is deleted, so state
holds open windows only. Rows older than the watermark are dropped before they reach a state, so a window that was given out never changes. The
state lives in RocksDB on the executors, with its changes in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.accum import DELTA, Digest
from quillon.operators.descriptive import clean, present
from quillon.operators.order import group_key

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_RESULT = "key string, start_ms long, n long, least double, most double, means array<double>, weights array<double>"


class _Windows(StatefulProcessor):
    """A digest for each (key, start)."""

    def __init__(self, delta: float, millis: int) -> None:
        self.acc, self.millis = Digest(delta), millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("digest", Digest.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.held.get() if self.held.exists() else None
        state = (old[0], old[1], old[2], list(old[3]), list(old[4])) if old is not None else self.acc.init()
        for part in rows:
            state = self.acc.update(state, part["x"].to_numpy(dtype=float))
        if old is None:
            self.handle.registerTimer(int(key[1]) + self.millis)
        self.held.update((int(state[0]), float(state[1]), float(state[2]), [float(v) for v in state[3]], [float(v) for v in state[4]]))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, least, most, means, weights = self.held.get()
        self.held.clear()
        yield pd.DataFrame({"key": [key[0]], "start_ms": [int(key[1])], "n": [n], "least": [least], "most": [most], "means": [np.array(means, float)], "weights": [np.array(weights, float)]})

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """Choose the state store that arbitrary state needs; for streams that start afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def windowed_digest(stream: DataFrame, ts: str, value: str, window: str, watermark: str, *keys: str, delta: float = DELTA) -> DataFrame:
    """keys, start, digest of every closed window: for append mode, with the state store of prepare(). Windows begin at multiples of their length since 1970, in UTC."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).where(present(value))
    spark = stream.sparkSession
    millis = int(spark.sql(f"SELECT CAST(INTERVAL {window} AS INTERVAL SECOND) AS w").first().w.total_seconds() * 1000)
    at = F.unix_millis(ts)
    rows = timed.select(group_key(keys).alias("key"), (at - F.pmod(at, F.lit(millis))).alias("start_ms"), F.col(ts).alias("ts"), clean(value).alias("x"))
    done = rows.groupBy("key", "start_ms").transformWithStateInPandas(_Windows(delta, millis), _RESULT, "append", "eventTime").withColumn("start", F.timestamp_millis("start_ms"))
    digest = F.struct("n", "least", "most", "means", "weights").alias("digest")
    if not keys:
        return done.select("start", digest)
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    return done.withColumn("_k", F.from_json("key", kinds)).select(*(F.col("_k")[k].alias(k) for k in keys), "start", digest)
