"""Query op6_top_k: the ten highest inner products of every hundredth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import topk
from quillon.llm.common import table


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: ids divisible by 100; candidates: every row but the query's own."""
    rows = table(spark, sf_dir, "embeddings").where(topk.usable()).select("vec_id", topk.quantised().alias("values"))
    return topk.top_k(rows, F.col("vec_id") % 100 == 0)


SQL = """
    WITH v AS (
      SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 10
"""
