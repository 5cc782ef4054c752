"""Query op3_license_scan: licence phrases and notices in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import licenses
from quillon.llm.common import documents


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every whole text of documents against the standing index."""
    return licenses.scan_licenses(documents(spark, sf_dir))


def _sql() -> str:
    index = licenses.Index()
    entries = ", ".join(f"({k}, '{e.label}', {e.need}, {len(e.rare)}, {str(e.base).lower()}, {len(e.required)})" for k, e in enumerate(index.entries))
    posted = ", ".join(f"('{w}', {k}, {i})" for w, at in sorted(index.postings.items()) for k, i in at)
    phrases = ", ".join(f"({k}, {n}, {o + j}, '{w}', {len(p)})" for k, e in enumerate(index.entries) for n, (o, p) in enumerate(e.required) for j, w in enumerate(p))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH entries(k, label, need, rare, base, n_phrases) AS (VALUES {entries}),
    posted(w, k, i) AS (VALUES {posted}),
    phrases(k, phrase, o, w, n) AS (VALUES {phrases}),
    cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
    ws AS (SELECT doc_id, ws, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM cut),
    votes AS (
      SELECT doc_id, p.k, pos - p.i AS start, count(*) AS n FROM ws JOIN posted p USING (w) GROUP BY ALL),
    near AS (SELECT v.doc_id, v.k, v.start, v.n FROM votes v JOIN entries e USING (k) WHERE v.n >= e.need),
    stands AS (
      SELECT x.doc_id, x.k, x.start, any_value(x.n) AS n, count(*) AS words
      FROM near x JOIN phrases p ON x.k = p.k JOIN ws ON ws.doc_id = x.doc_id AND ws.pos = x.start + p.o AND ws.w = p.w
      GROUP BY x.doc_id, x.k, x.start),
    hits AS (
      SELECT s.doc_id, s.start, e.label, e.base, s.n / e.rare::DOUBLE AS score
      FROM stands s JOIN entries e USING (k) JOIN (SELECT k, count(*) AS words FROM phrases GROUP BY k) f USING (k) WHERE s.words = f.words)
    SELECT c.doc_id, len(any_value(c.ws)) AS n_words, count(h.label) FILTER (h.base) AS n_base,
      min(h.start) FILTER (h.base) AS first_word, max(h.start) FILTER (h.base) AS last_word,
      coalesce(string_agg(DISTINCT h.label, ',' ORDER BY h.label) FILTER (h.base), '') AS base_labels,
      coalesce(string_agg(DISTINCT h.label, ',' ORDER BY h.label), '') AS labels, coalesce(max(h.score), 0.0)::DOUBLE AS score
    FROM cut c LEFT JOIN hits h ON c.doc_id = h.doc_id GROUP BY c.doc_id
    """


SQL = _sql()
