"""Query op4_fingerprint: digests of every document, of its edited text and of the next document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import fingerprint
from quillon.llm.common import documents


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses of every whole text."""
    return fingerprint.with_next(documents(spark, sf_dir))
