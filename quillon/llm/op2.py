"""Query op2_language_id: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import langid
from quillon.llm.common import documents, held_out


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the rows that aren't held out; predict every whole text from the text alone."""
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, ("doc_id", "held_out")).select("doc_id", F.col("held_out"), "lang_pred", "score")
