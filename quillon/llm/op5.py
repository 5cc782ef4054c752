"""Query op5_mixing: the documents mixed to target weights of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import mixing
from quillon.llm.common import documents


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each copy of a document in the mixture: doc_id, source, epoch, block_order, slot."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "epoch", "block_order", "slot")


def _sql() -> str:
    t = mixing.Target()
    h = lambda *parts: f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"
    seed = f"'{t.seed}'"
    entropy = "(SELECT ln(sum(pow(share, m))) - m * sum(pow(share, m) * ln(share)) / sum(pow(share, m)) FROM stats)"
    copies = f"(SELECT max(pow(share, m - 1)) / sum(pow(share, m)) <= {t.repeats} FROM stats)"
    steps = mixing.LEVELS * mixing.PASSES
    bisect = lambda name, good, low: f"""
    {name}(i, lo, hi) AS (
      SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
      SELECT i + 1, CASE WHEN {good} THEN {'m' if low else 'lo'} ELSE {'lo' if low else 'm'} END, CASE WHEN {good} THEN {'hi' if low else 'm'} ELSE {'m' if low else 'hi'} END
      FROM (SELECT *, (lo + hi) / 2 AS m FROM {name}) WHERE i < {steps})"""  # noqa: E731
    return f"""
    WITH RECURSIVE light AS (
      SELECT doc_id AS id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS tokens FROM documents),
    sums AS (SELECT source, count(*) AS n_docs, sum(tokens)::BIGINT AS tokens FROM light GROUP BY source HAVING sum(tokens) > 0),
    stats AS (SELECT *, tokens / (SELECT sum(tokens) FROM sums)::DOUBLE AS share FROM sums),
    {bisect("ent", f"{entropy} >= {t.entropy!r} * ln((SELECT count(*) FROM stats))", True)},
    {bisect("rep", copies, False)},
    ends AS (
      SELECT CASE WHEN (SELECT -sum(share * ln(share)) >= {t.entropy!r} * ln(count(*)) FROM stats) THEN 1.0 ELSE (SELECT max(lo) FROM ent WHERE i = {steps}) END AS e,
        CASE WHEN (SELECT max(1 / share) / count(*) <= {t.repeats} FROM stats) THEN 0.0 ELSE (SELECT max(hi) FROM rep WHERE i = {steps}) END AS r),
    a AS (SELECT round(greatest(e, r), 9) AS a FROM ends),
    plan AS (
      SELECT *, goal - whole * tokens AS part, CAST(ceil(n_docs / {mixing.BLOCK_ROWS}.0) AS BIGINT) AS blocks FROM (
        SELECT *, CAST(floor(goal / tokens) AS BIGINT) AS whole FROM (
          SELECT s.*, CAST(round(pow(share, a) / (SELECT sum(pow(share, a)) FROM stats, a) * (SELECT sum(tokens) FROM sums)) AS BIGINT) AS goal FROM stats s, a))),
    dealt AS (SELECT l.id, l.source, l.tokens, p.whole, p.part, {h(seed, "'block'", "l.id")} % p.blocks AS block FROM light l JOIN plan p USING (source)),
    per_block AS (SELECT source, block, sum(tokens)::BIGINT AS t, any_value(whole) AS epoch, any_value(part) AS part FROM dealt GROUP BY ALL),
    ordered AS (SELECT *, sum(t) OVER (PARTITION BY source ORDER BY block_order, block) AS upto FROM (SELECT *, {h(seed, "'order'", "epoch", "source", "block")} AS block_order FROM per_block)),
    judged AS (SELECT *, part - (upto - t) AS room, upto <= part AS fits, upto > part AND row_number() OVER (PARTITION BY source, upto > part ORDER BY block_order, block) = 1 AS is_cut FROM ordered),
    held AS (
      SELECT d.source, d.block, d.id, d.tokens, any_value(j.room) AS room, count(*) AS n, {h(seed, "'slot'", "any_value(d.whole)", "d.id")} AS slot
      FROM dealt d JOIN judged j ON d.source = j.source AND d.block = j.block AND j.is_cut GROUP BY d.source, d.block, d.id, d.tokens),
    rooms AS (
      SELECT *, room - sum(n * tokens) OVER (PARTITION BY source, block ORDER BY slot, id, tokens) + n * tokens AS space FROM held),
    cut AS (
      SELECT source, id, tokens, CASE WHEN space < 0 THEN 0 WHEN tokens = 0 THEN n ELSE least(n, space // tokens) END AS fits FROM rooms),
    copies AS (
      SELECT d.*, d.whole + CASE WHEN j.fits OR row_number() OVER (PARTITION BY d.source, d.id, d.tokens) <= c.fits THEN 1 ELSE 0 END AS copies
      FROM dealt d JOIN judged j ON d.source = j.source AND d.block = j.block
      LEFT JOIN cut c ON d.id IS NOT DISTINCT FROM c.id AND d.source = c.source AND d.tokens = c.tokens AND j.is_cut)
    SELECT id AS doc_id, source, epoch, {h(seed, "'order'", "epoch", "source", "block")} AS block_order, {h(seed, "'slot'", "epoch", "id")} AS slot
    FROM (SELECT *, unnest(generate_series(0, copies - 1)) AS epoch FROM copies WHERE copies > 0)
    """


SQL = _sql()
