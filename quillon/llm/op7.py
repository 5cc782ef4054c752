"""Query op7_line_dedup: documents without the lines that repeat others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import lines
from quillon.llm.common import documents


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number of lines, how many went, length and hash of what is left."""
    done = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), counts=True)
    return done.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
