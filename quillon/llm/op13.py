"""Query op13_quality: the quality of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import quality
from quillon.llm.common import documents, held_out, table

#: Scores from here on are predicted as good.
GOOD = 0.3


def fitted(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Word vectors of all texts; the network learns from the labelled rows that aren't held out."""
    docs = documents(spark, sf_dir)
    return quality.fit(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()), corpus=docs)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text from the text alone."""
    docs = documents(spark, sf_dir).select("doc_id", held_out().alias("held_out"), "text")
    done = quality.score(docs, fitted(spark, sf_dir), ("doc_id", "held_out"))
    return done.select("doc_id", "held_out", "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
