"""Queries of ranks, transforms, densities, special functions and resampling."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import dist
from quillon.functions import special as S
from quillon.operators import bootstrap as B
from quillon.operators import density as K
from quillon.operators import descriptive as D
from quillon.operators import resample as R
from quillon.operators import rng
from quillon.operators import transform as T
from quillon.operators.isotonic import monotone
from quillon.operators.storage import stored
from quillon.plans.descriptive import lineitem, rounded
from quillon.plans.register import Register, betai, bootstrap_rows, gammp, phi

query = Register()
QUERIES, ORACLES = query.queries, query.oracles


def _customers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")


@query("rank_all_ties", """
    SELECT p_partkey, rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS average, (rank() OVER w)::DOUBLE AS lowest, (count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE UNBOUNDED PRECEDING))::DOUBLE AS highest,
      (dense_rank() OVER w)::DOUBLE AS dense, (row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey))::DOUBLE AS ordinal
    FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""")
def rank_all_ties(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size")
    for ties, name in ((T.Ties.AVERAGE, "average"), (T.Ties.MIN, "lowest"), (T.Ties.MAX, "highest"), (T.Ties.DENSE, "dense"), (T.Ties.ORDINAL, "ordinal")):
        df = T.rank(df, "p_size", ties, "p_brand", order="p_partkey", out=name)
    return df.drop("p_brand", "p_size")


@query("normal_scores", f"""
    SELECT c_custkey, round((r - 0.375) / (n + 0.25), 9) AS back FROM (
      SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)""")
def normal_scores(spark, sf_dir):
    """The scores, taken back through the normal cdf."""
    s = T.normal_scores(_customers(spark, sf_dir), "c_acctbal", "c_mktsegment")
    return s.select("c_custkey", F.round(dist.Normal().cdf(F.col("score")), 9).alias("back"))


@query("ranks_without_keys", """
    SELECT o_orderkey, rank() OVER w + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0::DOUBLE AS average, (rank() OVER w)::DOUBLE AS lowest, (count(*) OVER (ORDER BY o_custkey RANGE UNBOUNDED PRECEDING))::DOUBLE AS highest,
      (dense_rank() OVER w)::DOUBLE AS dense, (row_number() OVER (ORDER BY o_custkey, o_orderkey))::DOUBLE AS ordinal
    FROM orders WINDOW w AS (ORDER BY o_custkey)""")
def ranks_without_keys(spark, sf_dir):
    """Ranks of the whole table, by ranges."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    for ties, name in ((T.Ties.AVERAGE, "average"), (T.Ties.MIN, "lowest"), (T.Ties.MAX, "highest"), (T.Ties.DENSE, "dense"), (T.Ties.ORDINAL, "ordinal")):
        df = T.rank(df, "o_custkey", ties, order="o_orderkey", out=name)
    return df.drop("o_custkey")


@query("box_cox", "SELECT o_orderkey, round((pow(o_totalprice, 0.5) - 1) / 0.5, 6) AS half, round(ln(o_totalprice), 9) AS log FROM orders")
def box_cox(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(T.box_cox("o_totalprice", 0.5), 6).alias("half"), F.round(T.box_cox("o_totalprice", 0.0), 9).alias("log"))


@query("yeo_johnson", """
    SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - c_acctbal, 1.5) - 1) / 1.5 END, 6) AS half,
      round(CASE WHEN c_acctbal >= 0 THEN ln(c_acctbal + 1) ELSE -(pow(1 - c_acctbal, 2) - 1) / 2 END, 2) AS zero, round(CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 2) - 1) / 2000 ELSE -ln(1 - c_acctbal) / 1000 END, 2) + 0.0 AS two
    FROM customer""")
def yeo_johnson(spark, sf_dir):
    x = "c_acctbal"
    return _customers(spark, sf_dir).select("c_custkey", F.round(T.yeo_johnson(x, 0.5), 6).alias("half"), F.round(T.yeo_johnson(x, 0.0), 2).alias("zero"), (F.round(T.yeo_johnson(x, 2.0) / 1000, 2) + 0.0).alias("two"))


def _tail(z: str) -> str:
    """SQL of -ln of the upper tail of the standard normal: from the series of its cdf, and from three standard deviations on by a continued fraction."""
    return f"CASE WHEN {z} < 3 THEN -ln(1 - {phi(z)}) ELSE {z} * {z} / 2 + 0.5 * ln(2 * pi()) + ln(list_reduce(list_concat([{z}], range(80, 0, -1)::DOUBLE[]), lambda a, k: {z} + k / a)) END"


@query("pit_and_map", f"""
    SELECT event_id, round(CASE WHEN z >= 3 THEN 1 - exp(-above) WHEN z <= -3 THEN exp(-below) ELSE {phi('z')} END, 8) AS u, round(above, 5) AS mapped FROM (
      SELECT event_id, z, {_tail('z')} AS above, {_tail('(-z)')} AS below FROM (SELECT event_id, (value - 50) / 30 AS z FROM events))""")
def pit_and_map(spark, sf_dir):
    """All events."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = dist.Normal(50, 30)
    return df.select("event_id", F.round(T.pit("value", n), 8).alias("u"), F.round(T.quantile_map("value", n, dist.Exponential(1.0)), 5).alias("mapped"))


@query("monotone_trend", """
    WITH d AS (SELECT date_diff('day', TIMESTAMP '1992-01-01', date_trunc('day', o_orderdate)) // 14 AS i, sum(o_totalprice) AS s, count(*)::DOUBLE AS c FROM orders GROUP BY 1),
    p AS (SELECT i, sum(s) OVER w AS s, sum(c) OVER w AS c, sum(s) OVER w - s AS s0, sum(c) OVER w - c AS c0 FROM d WINDOW w AS (ORDER BY i)),
    m AS (SELECT a.i AS j, b.i AS k, (b.s - a.s0) / (b.c - a.c0) AS mean FROM p a JOIN p b ON a.i <= b.i),
    low AS (SELECT j, k, min(mean) OVER (PARTITION BY j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM m)
    SELECT k AS fortnight, round(max(low), 4) AS trend FROM low GROUP BY k""")
def monotone_trend(spark, sf_dir):
    """The rising trend nearest to the mean price of each fortnight's orders; in SQL by the greatest of the least means."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01"))
    sums = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.floor(day / 14).alias("at")).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("c"))
    sums = stored(sums)
    fitted = monotone(sums, sums.agg(F.max("at")).first()[0] + 1)
    return fitted.join(sums, "at", "left_semi").select(F.col("at").alias("fortnight"), F.round("fitted", 4).alias("trend"))


@query("quantile_normalize", """
    WITH m AS (SELECT l_linenumber AS c, l_suppkey AS r, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
    n AS (SELECT count(DISTINCT r) AS n FROM m),
    s AS (SELECT c, list(v ORDER BY v) AS vs, count(*) AS m FROM m GROUP BY c),
    p AS (SELECT c, vs, i, (m - 1) * i / (n - 1)::DOUBLE AS p FROM s, n, unnest(range(0, n)) AS t(i)),
    t AS (SELECT list(x ORDER BY i) AS t FROM (
      SELECT i, avg(vs[floor(p)::INT + 1] + (vs[ceil(p)::INT + 1] - vs[floor(p)::INT + 1]) * (p - floor(p))) AS x FROM p GROUP BY i)),
    k AS (SELECT c, r, rank() OVER (PARTITION BY c ORDER BY v) - 1 + (count(*) OVER (PARTITION BY c, v) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY c) AS m FROM m),
    b AS (SELECT c, r, CASE WHEN m = 1 THEN (n - 1) / 2.0 ELSE k * (n - 1) / (m - 1)::DOUBLE END AS b FROM k, n)
    SELECT c::INT AS c, r, round(t[floor(b)::INT + 1] + (t[ceil(b)::INT + 1] - t[floor(b)::INT + 1]) * (b - floor(b)), 3) AS v FROM b, t""")
def quantile_normalize(spark, sf_dir):
    """All columns (line numbers) and all suppliers, those with missing columns too."""
    m = lineitem(spark, sf_dir).groupBy(F.col("l_linenumber").alias("c"), F.col("l_suppkey").alias("r")).agg(F.max("l_extendedprice").alias("v"))
    return rounded(T.quantile_normalize(m, "c", "r", "v"), 3)


@query("kde_gaussian", f"""
    WITH d AS (SELECT o_totalprice AS v FROM orders), s AS (SELECT count(*) AS n, stddev_samp(v) * pow(0.75 * count(*), -0.2) AS h FROM d), g AS (SELECT (10000.0 * unnest(range(0, 41)))::DOUBLE AS x)
    SELECT x, round(sum(exp(-0.5 * pow((x - v) / h, 2)) / sqrt(2 * pi())) / (any_value(n) * any_value(h)) * 1e6, 6) AS density FROM g, d, s GROUP BY x""")
def kde_gaussian(spark, sf_dir):
    fit = K.kde(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", K.Kernel.GAUSSIAN, K.SILVERMAN)
    grid = spark.range(41).select((F.col("id") * 10000.0).alias("x"))
    return fit.evaluate(grid, "x").select("x", F.round(F.col("density") * 1e6, 6).alias("density"))


@query("kde_epanechnikov", """
    WITH d AS (SELECT c_acctbal AS v FROM customer), g AS (SELECT (250.0 * unnest(range(-4, 41)))::DOUBLE AS x)
    SELECT x, round(sum(CASE WHEN abs(x - v) <= 300 THEN 0.75 * (1 - pow((x - v) / 300, 2)) ELSE 0 END) / (count(*) * 300) * 1e6, 6) AS density FROM g, d GROUP BY x""")
def kde_epanechnikov(spark, sf_dir):
    fit = K.kde(_customers(spark, sf_dir), "c_acctbal", K.Kernel.EPANECHNIKOV, K.Bandwidth("fixed", 300.0))
    return fit.evaluate(spark.range(-4, 41).select((F.col("id") * 250.0).alias("x")), "x").select("x", F.round(F.col("density") * 1e6, 6).alias("density"))


def _rules():
    rules = {
        K.Rule.STURGES: "ceil(log2(n)) + 1", K.Rule.RICE: "ceil(2 * pow(n, 1 / 3.0))", K.Rule.SQRT: "ceil(sqrt(n))", K.Rule.SCOTT: "ceil((hi - lo) / (3.49 * sd * pow(n, -1 / 3.0)))",
        K.Rule.FREEDMAN_DIACONIS: "ceil((hi - lo) / (2 * iqr * pow(n, -1 / 3.0)))",
    }
    for rule, k in rules.items():
        sql = f"""
        WITH s AS (SELECT count(*)::DOUBLE AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, stddev_samp(o_totalprice) AS sd, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders),
        k AS (SELECT *, ({k})::INT AS k FROM s), b AS (SELECT k, lo, hi, n, unnest(range(0, k)) AS bin FROM k),
        c AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / k)), k - 1)::INT AS bin, count(*) AS m FROM orders, k GROUP BY 1)
        SELECT b.bin::INT AS bin, round(coalesce(m, 0) / n / ((hi - lo) / k) * 1e6, 6) AS value FROM b LEFT JOIN c ON b.bin = c.bin"""

        def run(spark, sf_dir, rule=rule):
            h = K.histogram_auto(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", K.Bins(rule=rule), K.Norm.DENSITY)
            return h.select("bin", F.round(F.col("value") * 1e6, 6).alias("value"))

        query(f"histogram_auto_{rule.value}", sql)(run)


_rules()


@query("histogram_edges", """
    WITH e AS (SELECT unnest([0, 1, 2, 3, 4]) AS bin, unnest([1.0, 5.0, 10.0, 25.0, 40.0]) AS lo, unnest([5.0, 10.0, 25.0, 40.0, 48.0]) AS hi),
    c AS (SELECT bin, count(l_quantity) AS n FROM e LEFT JOIN lineitem ON l_quantity >= lo AND (l_quantity < hi OR bin = 4 AND l_quantity = hi) GROUP BY bin)
    SELECT bin::INT AS bin, round(n / (SELECT sum(n) FROM c), 9)::DOUBLE AS value FROM c""")
def histogram_edges(spark, sf_dir):
    h = K.histogram_auto(lineitem(spark, sf_dir), "l_quantity", K.Bins(edges=(1.0, 5.0, 10.0, 25.0, 40.0, 48.0)), K.Norm.PROBABILITY)
    return h.select("bin", F.round("value", 9).alias("value"))


@query("special_functions", f"""
    WITH g AS (SELECT q, q / 10.0 AS x FROM (SELECT DISTINCT l_quantity AS q FROM lineitem))
    SELECT q, round(sign(x) * {gammp('0.5', '(x * x)', 800)}, 9) AS erf, round(lgamma(x), 8) AS lgamma, round(exp(lgamma(x)) / 1e3, 7) AS gamma, round(lgamma(x) + lgamma(2.5) - lgamma(x + 2.5), 8) AS lbeta,
      round({gammp('x', '2.5', 200)}, 9) AS gammp, round(1 - {gammp('x', '2.5', 200)}, 9) AS gammq, round({betai('x', '3.0', '(q / 51.0)')}, 8) AS betai, round(q / 51.0, 8)::DOUBLE AS back_beta, round(q / 51.0, 9)::DOUBLE AS back_erf
    FROM g""")
def special_functions(spark, sf_dir):
    x, p = F.col("q") / 10, F.col("q") / 51
    return lineitem(spark, sf_dir).select(F.col("l_quantity").alias("q")).distinct().select(
        "q", F.round(S.column(S.erf, x), 9).alias("erf"), F.round(S.column(S.lgamma, x), 8).alias("lgamma"), F.round(S.column(S.gamma, x) / 1e3, 7).alias("gamma"), F.round(S.column(S.lbeta, x, 2.5), 8).alias("lbeta"),
        F.round(S.column(S.gammp, x, 2.5), 9).alias("gammp"), F.round(S.column(S.gammq, x, 2.5), 9).alias("gammq"), F.round(S.column(S.betai, x, 3.0, p), 8).alias("betai"),
        F.round(S.column(lambda a, p: S.betai(a, 3.0, S.inv_beta_reg(a, 3.0, p)), x, p), 8).alias("back_beta"), F.round(S.column(lambda p: S.erf(S.erf_inv(p)), p), 9).alias("back_erf"),
    )


@query("digamma", """
    WITH g AS (SELECT DISTINCT l_quantity AS q FROM lineitem)
    SELECT q, round(-0.57721566490153286 + coalesce(list_sum([1.0::DOUBLE / i FOR i IN range(1, q::INT)]), 0), 9) AS digamma FROM g""")
def digamma(spark, sf_dir):
    """All quantities."""
    q = F.col("q")
    return lineitem(spark, sf_dir).select(F.col("l_quantity").alias("q")).distinct().select("q", F.round(S.column(S.digamma, q), 9).alias("digamma"))


@query("logsumexp", "SELECT l_returnflag, round(max(l_quantity) + ln(sum(exp(l_quantity - 50)) / exp(max(l_quantity) - 50)), 8) AS lse FROM lineitem GROUP BY 1")
def logsumexp(spark, sf_dir):
    """ln sum exp of each flag's quantities."""
    return D.logsumexp(lineitem(spark, sf_dir), "l_quantity", "l_returnflag").select("l_returnflag", F.round("lse", 8).alias("lse"))


@query("resample_permutation", "SELECT d AS draw, 50 AS n, 1225.0::DOUBLE AS total FROM (SELECT unnest(range(0, 40)) AS d)")
def resample_permutation(spark, sf_dir):
    """Every draw holds every row once."""
    d = R.draw_table(spark, R.Scheme.PERMUTATION, 50, 40, 77)
    return d.groupBy("draw").agg(F.countDistinct("row").cast("int").alias("n"), F.sum("row").cast("double").alias("total"))


@query("resample_known_answers", "SELECT unnest(range(0, 10)) AS pos, unnest([2, 4, 5, 9, 3, 8, 7, 0, 1, 6])::BIGINT AS permuted, unnest([6, 1, 1, 0, 1, 6, 2, 6, 3, 5])::BIGINT AS booted, unnest([1, -1, 1, 1, -1, -1, -1, 1, 1, 1])::DOUBLE AS sign")
def resample_known_answers(spark, sf_dir):
    """The published streams of seed 77, draw 5."""
    p = R.draw_table(spark, R.Scheme.PERMUTATION, 10, 6, 77).where("draw = 5").select("pos", F.col("row").alias("permuted"))
    b = R.draw_table(spark, R.Scheme.BOOTSTRAP, 10, 6, 77).where("draw = 5").select("pos", F.col("row").alias("booted"))
    s = R.sign_table(spark, 12, 6, 77).where("draw = 5").select(F.posexplode("signs").alias("pos", "sign")).withColumn("pos", F.col("pos").cast("long"))
    return p.join(b, "pos").join(s, "pos")


@query("bootstrap_interval", f"""
WITH base AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_custkey, c_acctbal) - 1 AS place FROM customer),
drawn AS ({bootstrap_rows(11, rng.STREAM_TAG_RESAMPLE, 400, "(SELECT count(*) FROM base)")}),
stats AS (SELECT draw, avg(x) AS stat FROM drawn JOIN base ON place = drawn GROUP BY draw)
SELECT count(*) AS draws, round(quantile_cont(stat, 0.025), 6) AS lower, round(quantile_cont(stat, 0.975), 6) AS upper FROM stats""")
def bootstrap_interval(spark, sf_dir):
    """The 95 % percentile interval of the mean balance, over 400 draws."""
    draws = R.run_draws(_customers(spark, sf_dir), "c_acctbal", "c_custkey", R.Scheme.BOOTSTRAP, 400, 11, lambda x: float(np.mean(x)))
    return rounded(draws.agg(F.count("*").alias("draws"), R.boot_interval("stat", 0.95).alias("ci")).select("draws", F.col("ci")[0].alias("lower"), F.col("ci")[1].alias("upper")))


@query("bootstrap_lineitem", f"""
WITH base AS (SELECT l_quantity, l_orderkey, round(l_extendedprice * 100)::BIGINT AS cents, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS place FROM lineitem),
drawn AS ({bootstrap_rows(2024, rng.STREAM_TAG_RESAMPLE, 12, "(SELECT count(*) FROM base)")})
SELECT draw, count(*) AS n, count(DISTINCT place) AS n_rows, sum(l_quantity)::DOUBLE AS quantity, sum(cents)::BIGINT AS cents, sum((pos % 1009) * (l_orderkey % 1013))::BIGINT AS in_order
FROM drawn JOIN base ON place = drawn GROUP BY draw""")
def bootstrap_lineitem(spark, sf_dir):
    """Totals of twelve bootstrap draws of all rows of lineitem; in_order depends on what stands where."""
    by = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    base = lineitem(spark, sf_dir).select(*by, "l_quantity", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    totals = [F.count("*").alias("n"), F.countDistinct("_row").alias("n_rows"), F.sum("l_quantity").cast("double").alias("quantity"), F.sum("cents").alias("cents")]
    return B.bootstrap(base, by, 12, 2024, *totals, F.sum((F.col("_pos") % 1009) * (F.col("l_orderkey") % 1013)).alias("in_order"))


@query("permutation_p")
def permutation_p(spark, sf_dir):
    """The p-value of a difference of means under 199 shuffles."""
    df = _customers(spark, sf_dir).where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).orderBy("c_custkey")
    half = df.where("c_mktsegment = 'BUILDING'").count()
    gap = lambda x: float(x[:half].mean() - x[half:].mean())
    ordered = df.withColumn("place", F.concat_ws("|", "c_mktsegment", F.lpad(F.col("c_custkey").cast("string"), 12, "0")))
    observed = df.agg(F.avg(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))) - F.avg(F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_acctbal")))).first()[0]
    draws = R.run_draws(ordered, "c_acctbal", "place", R.Scheme.PERMUTATION, 199, 5, gap)
    return draws.agg(F.count("*").alias("draws"), R.null_p("stat", observed, R.Sidedness.TWO_SIDED).alias("p"))


@query("uniform_stream", "SELECT 4000 AS n, true AS spread")
def uniform_stream(spark, sf_dir):
    """Uniform numbers by draw: mean and variance within four standard errors."""
    u = rng.sampled(spark, lambda x: x, 4000, 9)
    return u.agg(F.count("*").cast("int").alias("n"), ((F.abs(F.avg("value") - 0.5) < 4 * math.sqrt(1 / 12 / 4000)) & (F.abs(F.var_pop("value") - 1 / 12) < 0.006) & (F.min("value") > 0) & (F.max("value") < 1)).alias("spread"))
