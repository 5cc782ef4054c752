"""What the text operators share: tables, shared storage, held-out folds, bounded models."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.storage import shared_dir

#: Rows whose crc32(id) mod FOLDS is 0 are held out of every training set.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return table(spark, sf_dir, "documents")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows of the held-out fold; a null id counts as held out, so nothing is learned from it."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % FOLDS == 0, F.lit(True))


#: Tables that this process has stored, in order.
_stored: list[str] = []


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write the rows as a table in the shared folder and read them back: the lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", codec).parquet(path)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A with-block at whose end the tables stored in it are deleted, but for those given to keep."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.first, self.kept = spark, len(_stored), set()

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """Store rows whose table outlives the block."""
        out = stored(df)
        self.kept.add(_stored[-1])
        return out

    def only(self, df: DataFrame) -> DataFrame:
        """Store rows whose table outlives the block, and delete what else was stored in it so far."""
        out = stored(df)
        self.kept = {_stored[-1]}
        self.clear()
        return out

    def __exit__(self, *_) -> None:
        self.clear()

    def clear(self) -> None:
        jvm = self.spark._jvm
        for path in [p for p in _stored[self.first :] if p not in self.kept]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            _stored.remove(path)


def dealt_join(rows: DataFrame, table: DataFrame, on: list[str], n: str, share: int = 10_000) -> DataFrame:
    """rows joined to a table that has one row for each key; its column n is the number of rows of the key.

    Keys that hold more than one in share of all rows are broadcast, fewer than share of them; the rows of other keys meet in a shuffle. So
    no task gets the rows of a frequent key.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) * share > total
    hot, rest = table.where(often), table.where(~often)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest, on))


def bounded_sample(rows: DataFrame, classes: str, per_class: int, key: str = "doc_id", most_classes: int = 1024) -> DataFrame:
    """About the per_class rows of each class with the least hash of their key: the same rows on every run and partitioning.

    The classes are counted first, so every task keeps only rows whose hash lies below the share that is wanted (and five standard
    deviations more); the rows that meet in one task for a class are bounded by per_class, not by the table.
    """
    from pyspark.sql import Window

    counts = rows.groupBy(classes).agg(F.count("*").alias("_n"))
    if len(counts.limit(most_classes + 1).collect()) > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    wanted = per_class + 5 * per_class**0.5 + 10
    share = F.pmod(F.xxhash64(F.lit("sample"), F.col(key).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows.withColumn("_share", share).join(F.broadcast(counts), classes).where(F.col("_share") * F.col("_n") <= wanted)  # at most most_classes rows
    order = Window.partitionBy(classes).orderBy("_share", F.col(key))
    return near.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= per_class).select(rows.columns)
