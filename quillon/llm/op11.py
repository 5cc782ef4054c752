"""Query op11_centroids: eight clusters of the embeddings, after ten rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import cluster
from quillon.llm.common import table

K, ROUNDS, SEED, WIDTH = 8, 10, 3, 64


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector of 64 finite components."""
    return cluster.described(*cluster.clusters(cluster.usable_vectors(table(spark, sf_dir, "embeddings"), "embedding", WIDTH), K, ROUNDS, SEED))


def _sql() -> str:
    """The rounds one after the other: a_n assigns, c_n holds the centroids as (k, e)."""
    steps = [f"""
    v AS MATERIALIZED (
      SELECT row_number() OVER () AS rid, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) = {WIDTH} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR) NULLS LAST, e) - 1 AS k, e FROM v QUALIFY k < {K})"""]
    assign = "a{n} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v.e) AS e, arg_min(k, d * {K} + k) AS k, min(d) AS d FROM (SELECT rid, vec_id, v.e, c.k, list_sum([(v.e[i] - c.e[i]) * (v.e[i] - c.e[i]) FOR i IN range(1, {W} + 1)])::BIGINT AS d FROM v, c{n} c) v GROUP BY rid)"
    for n in range(ROUNDS):
        steps.append(assign.format(n=n, K=K, W=WIDTH))
        steps.append(f"""
    m{n} AS (SELECT k, pos, sum(x)::BIGINT AS s, count(*) AS m FROM (SELECT k, unnest(e) AS x, unnest(range(1, {WIDTH} + 1)) AS pos FROM a{n}) GROUP BY k, pos),
    n{n} AS (SELECT k, list((s - ((s % m) + m) % m) // m ORDER BY pos) AS e FROM m{n} GROUP BY k),
    c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.e, c.e) AS e FROM c{n} c LEFT JOIN n{n} n ON n.k = c.k)""")
    steps.append(assign.format(n=ROUNDS, K=K, W=WIDTH))
    return f"""
    WITH {", ".join(steps)}
    SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
    FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.k"""


SQL = _sql()
