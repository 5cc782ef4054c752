"""The folder that driver and executors share, tables stored in it, and joins whose hot keys don't meet in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder of the context. Where neither is set, a temporary folder becomes it, in local mode only: a cluster needs one that is shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not found and context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared_')}"
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back: the lineage ends, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_join(rows: DataFrame, table: DataFrame, on: list[str], n: str, share: int = 1000) -> DataFrame:
    """rows joined to a table that has one row for each of their keys; n is the table's column with the number of rows of a key.

    Keys with more than one in share of all rows are broadcast, fewer than share of them; the others meet in a shuffle.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) * share > total
    hot, rest = F.broadcast(table.where(often)), table.where(~often)
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(table.where(often).select(on)), on, "left_anti").join(rest, on))
