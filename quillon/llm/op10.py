"""Query op10_sentencepiece: every document encoded and decoded again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import spm
from quillon.llm.common import documents


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and hash of the ids of every whole text, and whether they decode to it."""
    text = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    docs = documents(spark, sf_dir).withColumn("n_chars", F.length("text").cast("long")).withColumn("text_sha256", text("text"))
    done = spm.encode(docs, spm.load(), ("doc_id", "n_chars", "text_sha256"), check=True).withColumn("decoded_sha256", text("decoded"))
    return done.select(
        "doc_id", "n_chars", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        "decoded_sha256", F.col("decoded_sha256").eqNullSafe(F.col("text_sha256")).alias("round_trip"),
    )
