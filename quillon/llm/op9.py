"""Query op9_near_duplicates: the class of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import neardup
from quillon.llm.common import documents


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the least doc_id of its near duplicates), and whether the document is the one that stays."""
    found = neardup.classes(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "class_id", ((F.col("id") == F.col("class_id")) & (F.col("content") == F.col("class_content"))).alias("stays"))
