"""Query op8_toxicity: the toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import toxic
from quillon.llm.common import documents, held_out, table


def fitted(spark: SparkSession, sf_dir: str) -> toxic.Model:
    """The model learned from the labelled rows that aren't held out."""
    return toxic.fit(documents(spark, sf_dir).where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text from the text alone."""
    docs = documents(spark, sf_dir).select("doc_id", held_out().alias("held_out"), "text")
    return toxic.score(docs, fitted(spark, sf_dir), ("doc_id", "held_out")).select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
