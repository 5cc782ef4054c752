"""Queries of graphs, enhancement and permutation inference. The lattice is quantity x discount x tax of lineitem, its map a cell mean."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import graph as G
from quillon.operators import nulls as N
from quillon.operators import permute as P
from quillon.operators import tfce as T
from quillon.operators.storage import shared_dir
from quillon.plans.descriptive import lineitem
from quillon.plans.register import Register

query = Register()
QUERIES, ORACLES = query.queries, query.oracles

DIMS = (10, 11, 9)


def _cells(spark, sf_dir, *more):
    """(lin, value): mean price by cell of the lattice."""
    x, y, z = F.floor((F.col("l_quantity") - 1) / 5), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)
    lin = ((x * DIMS[1] + y) * DIMS[2] + z).cast("long").alias("lin")
    price = F.col("l_extendedprice") / F.col("l_quantity") / 1000
    return lineitem(spark, sf_dir).groupBy(lin, *more).agg(F.avg(price).alias("value"))


_CELL = f"((floor((l_quantity - 1) / 5) * {DIMS[1]} + round(l_discount * 100)) * {DIMS[2]} + round(l_tax * 100))::BIGINT"


@query("graph_edges", f"""
    WITH c AS (SELECT DISTINCT {_CELL} AS lin FROM lineitem), n AS (SELECT lin, row_number() OVER (ORDER BY lin) - 1 AS node, lin // {DIMS[1] * DIMS[2]} AS x, lin // {DIMS[2]} % {DIMS[1]} AS y, lin % {DIMS[2]} AS z FROM c)
    SELECT a.node, count(*) AS degree FROM n a JOIN n b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND a.lin <> b.lin AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 2 GROUP BY 1""")
def graph_edges(spark, sf_dir):
    """Degrees in the mask of cells that occur, edges included."""
    nodes = G.node_table(spark, DIMS, _cells(spark, sf_dir).select("lin"))
    return G.edge_table(nodes, DIMS, G.Conn.EDGE).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


@query("graph_arrays", "SELECT c AS conn, 990 AS n, e FROM (VALUES (6, 2 * (9 * 11 * 9 + 10 * 10 * 9 + 10 * 11 * 8)), (26, 28 * 31 * 25 - 990), (18, 28 * 31 * 25 - 990 - 8 * 9 * 10 * 8)) t(c, e)")
def graph_arrays(spark, sf_dir):
    """Nodes and directed edges of the full lattice."""
    rows = [(int(k), G.Domain.from_volume(DIMS, k).n_nodes, G.Domain.from_volume(DIMS, k).n_edges) for k in G.Conn]
    return spark.createDataFrame(rows, "conn int, n int, e int")


def _maps(spark, sf_dir):
    """(map_id, node, stat): the standardised cell means of each return flag, on the full lattice."""
    cells = _cells(spark, sf_dir, "l_returnflag")
    flags = F.create_map(*(F.lit(x) for p in (("A", 0), ("N", 1), ("R", 2)) for x in p))
    every = spark.range(DIMS[0] * DIMS[1] * DIMS[2]).select(F.col("id").alias("lin")).crossJoin(F.broadcast(spark.range(3).select(F.col("id").alias("map_id"))))  # three rows
    have = cells.select("lin", flags[F.col("l_returnflag")].cast("long").alias("map_id"), "value")
    return every.join(have, ["lin", "map_id"], "left").select("map_id", F.col("lin").alias("node"), F.round(F.coalesce(F.col("value"), F.lit(1.0)) * 4 - 4, 6).alias("stat"))


def _domain():
    return G.Domain.from_volume(DIMS, 6)


def _enhanced_sql(bands: str) -> str:
    """SQL of an enhancement of the maps: bands is a query of (map_id, side, k, h, w) on maps m; a node belongs to a band where side x stat is above h."""
    return f"""
    WITH RECURSIVE cells AS (SELECT {_CELL} AS lin, l_returnflag AS flag, avg(l_extendedprice / l_quantity / 1000) AS value FROM lineitem GROUP BY ALL),
    m AS (
      SELECT f.map_id, g.node, round(coalesce(c.value, 1.0) * 4 - 4, 6) AS stat
      FROM (VALUES (0, 'A'), (1, 'N'), (2, 'R')) f(map_id, flag) CROSS JOIN (SELECT unnest(range(0, {DIMS[0] * DIMS[1] * DIMS[2]})) AS node) g
      LEFT JOIN cells c ON c.flag = f.flag AND c.lin = g.node),
    bands AS ({bands}),
    inside AS (SELECT m.map_id, b.side, b.k, b.w, m.node FROM m JOIN bands b ON m.map_id = b.map_id AND b.side * m.stat > b.h),
    steps AS (
      SELECT i.map_id, i.side, i.k, i.node AS src, j.node AS dst FROM inside i JOIN inside j ON i.map_id = j.map_id AND i.side = j.side AND i.k = j.k
      AND (j.node IN (i.node - {DIMS[1] * DIMS[2]}, i.node + {DIMS[1] * DIMS[2]})
        OR j.node IN (i.node - {DIMS[2]}, i.node + {DIMS[2]}) AND j.node // {DIMS[1] * DIMS[2]} = i.node // {DIMS[1] * DIMS[2]}
        OR j.node IN (i.node - 1, i.node + 1) AND j.node // {DIMS[2]} = i.node // {DIMS[2]})),
    reached(map_id, side, k, src, dst) AS (
      SELECT map_id, side, k, node, node FROM inside
      UNION SELECT r.map_id, r.side, r.k, r.src, s.dst FROM reached r JOIN steps s ON r.map_id = s.map_id AND r.side = s.side AND r.k = s.k AND r.dst = s.src),
    sizes AS (SELECT map_id, side, k, src AS node, count(*) AS size FROM reached GROUP BY ALL),
    summed AS (SELECT map_id, node, sum(i.side * sqrt(size) * w) AS t FROM sizes JOIN inside i USING (map_id, side, k, node) GROUP BY ALL)
    SELECT m.map_id::BIGINT AS map_id, m.node::BIGINT AS node, round(coalesce(t, 0.0), 6) + 0.0 AS tfce FROM m LEFT JOIN summed USING (map_id, node)"""


def _grid_sql(start: float, step: float, weight: str) -> str:
    return f"""
      SELECT map_id, side, k, {start} + k * {step} AS h, {weight} AS w
      FROM (SELECT map_id, max(abs(stat)) AS top FROM m GROUP BY map_id), (VALUES (1), (-1)) s(side), (SELECT unnest(range(0, 1000)) AS k) WHERE {start} + k * {step} < top"""


def _rounded(df):
    return df.select("map_id", "node", (F.round("tfce", 6) + 0.0).alias("tfce"))


_SETTINGS = {
    "exact": ("exact", None), "nilearn": ("nilearn", None),
    "smith_nichols": ({"weighting": "smith_nichols", "start": 0.25, "step": 0.25}, _enhanced_sql(_grid_sql(0.25, 0.25, "pow(0.25 + k * 0.25, 2) * 0.25"))),
    "fslmaths": ({"weighting": "fslmaths", "start": 0.25, "step": 0.25}, _enhanced_sql(_grid_sql(0.25, 0.25, "pow(0.25 + k * 0.25, 2)"))),
    "mne": ({"weighting": "mne", "start": 0.5, "step": 0.25}, _enhanced_sql(_grid_sql(0.5, 0.25, "CASE WHEN k = 0 THEN 0.25 ELSE 0.0625 END"))),
}
for _name, (_params, _sql) in _SETTINGS.items():
    query(f"tfce_{_name}", _sql)(lambda spark, sf_dir, p=_params: _rounded(T.tfce(_maps(spark, sf_dir), _domain(), p, T.Tail.TWO_SIDED)))


_H, _W = [0.2, 0.6, 1.1, 1.7], [0.5, 1.0, 0.25, 2.0]
_BANDS_SQL = _enhanced_sql(f"SELECT map_id, 1 AS side, k, h, w FROM (SELECT DISTINCT map_id FROM m), (VALUES {', '.join(f'({k}, {h}, {w})' for k, (h, w) in enumerate(zip(_H, _W, strict=True)))}) b(k, h, w)")


@query("tfce_bands", _BANDS_SQL)
def tfce_bands(spark, sf_dir):
    return _rounded(T.tfce_bands(_maps(spark, sf_dir), _domain(), _H, _W, 0.5))


@query("tfce_bands_naive", _BANDS_SQL)
def tfce_bands_naive(spark, sf_dir):
    """By DataFrame joins alone."""
    shared_dir(spark)
    edges = G.edge_table(G.node_table(spark, DIMS), DIMS, 6)
    return _rounded(T.tfce_naive(_maps(spark, sf_dir), edges, _H, _W, 0.5))


def _subjects(spark, sf_dir, n: int = 12):
    """(subject, node, value): mean prices by customer group on a small lattice of quantity and discount."""
    df = lineitem(spark, sf_dir)
    node = (F.floor((F.col("l_quantity") - 1) / 10) * 11 + F.round(F.col("l_discount") * 100)).cast("long").alias("node")
    return df.groupBy((F.col("l_orderkey") % n).cast("long").alias("subject"), node).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("value"))


@query("tfce_ols_shuffles")
def tfce_ols_shuffles(spark, sf_dir):
    """200 row shuffles for a tested column with a confound."""
    x, c = np.arange(12.0), np.sin(np.arange(12.0))
    r = P.tfce_ols(_subjects(spark, sf_dir), G.Domain.from_volume((5, 11, 1), 6), tested=x, confounds=c[:, None], params="exact", seed=4, n_perm=200, num_partitions=4)
    return r.to_df(spark)


@query("tfce_ols_enumerated")
def tfce_ols_enumerated(spark, sf_dir):
    """All 2^8 sign patterns of the mean of eight subjects."""
    data = _subjects(spark, sf_dir, 8).withColumn("value", F.col("value") - 1.0)
    return P.tfce_ols(data, G.Domain.from_volume((5, 11, 1), 6), params="nilearn", tail="positive", seed=1, n_perm=256, num_partitions=4).to_df(spark)


_FLIPS_SQL = """
    WITH RECURSIVE y AS (
      SELECT l_orderkey % 8 AS s, (floor((l_quantity - 1) / 10) * 11 + round(l_discount * 100))::BIGINT AS node, avg(l_extendedprice / l_quantity / 1000) - 1 AS y FROM lineitem GROUP BY ALL),
    r AS (SELECT draw, node, sum((1 - 2 * ((draw >> s) & 1)) * y) / sqrt(8 * sum(y * y)) AS r FROM y, (SELECT unnest(range(0, 256)) AS draw) GROUP BY draw, node),
    m AS (SELECT draw, node, r * sqrt(7) / sqrt(1 - r * r) AS stat FROM r),
    inside AS (SELECT draw, k, node FROM m JOIN (SELECT unnest(range(0, 1000)) AS k) ON stat > 0.5 + 0.5 * k),
    steps AS (
      SELECT i.draw, i.k, i.node AS src, j.node AS dst FROM inside i JOIN inside j ON i.draw = j.draw AND i.k = j.k
      AND (j.node IN (i.node - 11, i.node + 11) OR j.node IN (i.node - 1, i.node + 1) AND j.node // 11 = i.node // 11)),
    reached(draw, k, src, dst) AS (
      SELECT draw, k, node, node FROM inside UNION SELECT r.draw, r.k, r.src, s.dst FROM reached r JOIN steps s ON r.draw = s.draw AND r.k = s.k AND r.dst = s.src),
    sizes AS (SELECT draw, k, src AS node, count(*) AS size FROM reached GROUP BY ALL),
    summed AS (SELECT draw, node, sum(sqrt(size) * pow(0.5 + 0.5 * k, 2) * 0.5) AS t FROM sizes GROUP BY ALL),
    e AS (SELECT m.draw, m.node, m.stat, round(coalesce(t, 0.0), 9) AS t FROM m LEFT JOIN summed USING (draw, node)),
    tops AS (SELECT draw, max(t) AS top FROM e GROUP BY draw),
    o AS (SELECT node, stat, t FROM e WHERE draw = 0),
    u AS (SELECT o.node, count(*) FILTER (e.t >= o.t) / 256.0::DOUBLE AS p_unc FROM o JOIN e ON e.node = o.node GROUP BY o.node),
    f AS (SELECT o.node, count(*) FILTER (top >= o.t) / 256.0::DOUBLE AS p_fwe FROM o, tops GROUP BY o.node)
    SELECT o.node, round(stat, 6) AS stat, round(t, 4) AS tfce, p_fwe, p_unc FROM o JOIN u USING (node) JOIN f USING (node)"""
_FLIPS = {"weighting": "smith_nichols", "start": 0.5, "step": 0.5}


@query("tfce_ols_tables", _FLIPS_SQL)
def tfce_ols_tables(spark, sf_dir):
    """All 2^8 sign patterns of the mean of eight subjects, from blocks of nodes."""
    data = _subjects(spark, sf_dir, 8).withColumn("value", F.col("value") - 1.0)
    found, _ = N.inference(data, G.Domain.from_volume((5, 11, 1), 6), params=_FLIPS, tail="positive", seed=1, n_perm=256, width=16)
    return found.select("node", F.round("stat", 6).alias("stat"), F.round("tfce", 4).alias("tfce"), "p_fwe", "p_unc")


@query("node_stats", """
    WITH d AS (SELECT l_orderkey % 12 AS s, (floor((l_quantity - 1) / 10) * 11 + round(l_discount * 100))::BIGINT AS node, avg(l_extendedprice / l_quantity / 1000) AS y FROM lineitem GROUP BY ALL),
    r AS (SELECT node, corr(y, s) AS r FROM d GROUP BY node)
    SELECT node, round(r * sqrt(10) / sqrt(1 - r * r), 6) AS stat FROM r""")
def node_stats(spark, sf_dir):
    """The t statistic of a tested column at each node."""
    return P.node_stats(_subjects(spark, sf_dir), np.arange(12.0), None).select("node", F.round("stat", 6).alias("stat"))


@query("masked_import_export", f"""
    WITH c AS (SELECT DISTINCT {_CELL} AS lin FROM lineitem WHERE l_returnflag = 'A')
    SELECT g.lin, CASE WHEN c.lin IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS stat FROM (SELECT unnest(range(0, {DIMS[0] * DIMS[1] * DIMS[2]})) AS lin) g LEFT JOIN c ON c.lin = g.lin""")
def masked_import_export(spark, sf_dir):
    """Masked data in, and a map of ones out, over the whole box."""
    from quillon.sources import masked

    cells = _cells(spark, sf_dir, "l_returnflag").where("l_returnflag = 'A'").select(F.lit(0).alias("subject"), "lin", "value")
    data = masked.import_from(cells, DIMS)
    one = data.values.select("node", F.lit(1.0).alias("stat"), F.lit(1.0).alias("tfce"), F.lit(1.0).alias("p_fwe"), F.lit(1.0).alias("p_unc"))
    return masked.export_to(one, data.nodes, DIMS).select("lin", "stat")
