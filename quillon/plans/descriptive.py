"""Queries of the descriptive aggregates and accumulators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import accum, exact, select
from quillon.operators import descriptive as D
from quillon.plans.register import Register

query = Register()
QUERIES, ORACLES = query.queries, query.oracles


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_G1 = "skewness({x}) * (count({x}) - 2) / sqrt(count({x})::DOUBLE * (count({x}) - 1))"


@query("describe_by_group", f"""
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(min(l_extendedprice), 4) AS min,
      round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3,
      round(max(l_extendedprice), 4) AS max, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd,
      round({_G1.format(x='l_extendedprice')}, 4) AS skewness, round(kurtosis_pop(l_extendedprice), 4) AS kurtosis
    FROM lineitem GROUP BY ALL""")
def describe_by_group(spark, sf_dir):
    return rounded(D.describe(lineitem(spark, sf_dir), "l_extendedprice", "l_returnflag", "l_linestatus"), 4)


@query("quantiles_by_group", """
    SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.01), 6) AS p1, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.999), 6) AS p999 FROM orders GROUP BY 1""")
def quantiles_by_group(spark, sf_dir):
    """Exact quantiles by selection."""
    q = select.quantiles(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", [0.01, 0.5, 0.999], "o_orderpriority")
    return q.select("o_orderpriority", "n", *(F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(("p1", "p50", "p999"))))


#: Every seventh quantity made missing, on both sides: NaN or null by turns.
_NAN = "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END"


def _holed(spark, sf_dir) -> DataFrame:
    k = F.col("l_orderkey") % 14
    return lineitem(spark, sf_dir).withColumn("x", F.when(k == 0, F.lit(float("nan"))).when(k == 7, F.lit(None).cast("double")).otherwise(F.col("l_quantity")))


@query("nan_omitted", f"SELECT l_returnflag, count({_NAN}) AS n, min({_NAN}) AS lo, max({_NAN}) AS hi, max({_NAN}) - min({_NAN}) AS spread, round(avg({_NAN}), 6) AS mean, round(quantile_cont({_NAN}, 0.5), 6) AS median FROM lineitem GROUP BY 1")
def nan_omitted(spark, sf_dir):
    return rounded(_holed(spark, sf_dir).groupBy("l_returnflag").agg(D.count("x").alias("n"), D.minimum("x").alias("lo"), D.maximum("x").alias("hi"), D.value_range("x").alias("spread"), D.mean("x").alias("mean"), D.median("x").alias("median")))


@query("variance_both_divisors", f"SELECT l_linestatus, round(var_samp({_NAN}), 6) AS v1, round(var_pop({_NAN}), 6) AS v0, round(stddev_samp({_NAN}), 6) AS s1, round(stddev_pop({_NAN}), 6) AS s0 FROM lineitem GROUP BY 1")
def variance_both_divisors(spark, sf_dir):
    s, p = D.Ddof.SAMPLE, D.Ddof.POPULATION
    return rounded(_holed(spark, sf_dir).groupBy("l_linestatus").agg(D.var("x", s).alias("v1"), D.var("x", p).alias("v0"), D.sd("x", s).alias("s1"), D.sd("x", p).alias("s0")))


@query("moments", f"SELECT event_type, count(value) AS n, round({_G1.format(x='value')}, 6) AS g1, round(kurtosis_pop(value), 6) AS g2 FROM events GROUP BY 1")
def moments(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(df.groupBy("event_type").agg(D.count("value").alias("n"), D.skewness("value").alias("g1"), D.kurtosis("value").alias("g2")))


@query("comoment", "SELECT l_returnflag, round(covar_samp(l_extendedprice, l_quantity), 3) AS cov, round(corr(l_extendedprice, l_quantity), 8) AS r FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1")
def comoment(spark, sf_dir):
    g = _holed(spark, sf_dir).groupBy("l_returnflag")
    return g.agg(F.round(D.cov("l_extendedprice", "x"), 3).alias("cov"), F.round(D.pearson("l_extendedprice", "x"), 8).alias("r"))


@query("exact_sum", "SELECT c_mktsegment, count(*) AS n, round(fsum(c_acctbal), 4) AS sum FROM customer GROUP BY 1")
def exact_sum(spark, sf_dir):
    return rounded(accum.exact_sum(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_acctbal", "c_mktsegment"), 4)


@query("two_pass_variance", """
    SELECT l_returnflag, l_linenumber, n, round(v.mean, 6) AS mean, round(fsum((x - mean) * (x - mean)) / (n - 1), 2) AS var
    FROM (SELECT l_returnflag, l_linenumber, l_extendedprice + 1e7 AS x, count(*) OVER g AS n, fsum(l_extendedprice + 1e7) OVER g / count(*) OVER g AS mean FROM lineitem WINDOW g AS (PARTITION BY l_returnflag, l_linenumber)) AS v
    GROUP BY l_returnflag, l_linenumber, n, v.mean""")
def two_pass_variance(spark, sf_dir):
    """Variances of prices far from zero, from exact sums."""
    found = exact.two_pass(lineitem(spark, sf_dir).withColumn("x", F.col("l_extendedprice") + 1e7), "x", "l_returnflag", "l_linenumber")
    return found.select("l_returnflag", "l_linenumber", "n", F.round("mean", 6).alias("mean"), F.round("var", 2).alias("var"))


@query("histogram_fixed", """
    WITH b AS (SELECT l_returnflag, CASE WHEN l_quantity < 5 THEN -1 WHEN l_quantity > 45 THEN 8 ELSE least(floor((l_quantity - 5) / 5.0), 7) END::INT AS b FROM lineitem),
    g AS (SELECT l_returnflag, unnest(range(0, 8)) AS bin FROM (SELECT DISTINCT l_returnflag FROM lineitem))
    SELECT g.l_returnflag, g.bin::INT AS bin, count(b.b) AS n, (5.0 + 5.0 * g.bin)::DOUBLE AS lower,
      round(sum(count(b.b)) OVER (PARTITION BY g.l_returnflag ORDER BY g.bin) / sum(count(b.b)) OVER (PARTITION BY g.l_returnflag), 9)::DOUBLE AS ecdf,
      (SELECT count(*) FROM b u WHERE u.l_returnflag = g.l_returnflag AND u.b = -1) AS underflow, (SELECT count(*) FROM b u WHERE u.l_returnflag = g.l_returnflag AND u.b = 8) AS overflow
    FROM g LEFT JOIN b ON b.l_returnflag = g.l_returnflag AND b.b = g.bin GROUP BY g.l_returnflag, g.bin""")
def histogram_fixed(spark, sf_dir):
    h = accum.histogram(lineitem(spark, sf_dir), "l_quantity", 5.0, 45.0, 8, "l_returnflag").withColumn("e", accum.ecdf("counts"))
    flat = h.select("l_returnflag", "underflow", "overflow", "edges", F.posexplode(F.arrays_zip("counts", "e")).alias("bin", "z"))
    return flat.select("l_returnflag", "bin", F.col("z.counts").alias("n"), F.col("edges")[F.col("bin")].alias("lower"), F.round("z.e", 9).alias("ecdf"), "underflow", "overflow")


@query("accumulated_moments", f"""
    SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 5) AS mean, round(var_samp(l_extendedprice) / 1e6, 6) AS var, round({_G1.format(x='l_extendedprice')}, 8) AS skewness, round(kurtosis_pop(l_extendedprice), 8) AS kurtosis,
      round(fsum(l_extendedprice), 2) AS sum FROM lineitem GROUP BY 1""")
def accumulated_moments(spark, sf_dir):
    """States by flag, status and line number, rolled up to the flag."""
    df = lineitem(spark, sf_dir)
    m, s = accum.Moments(), accum.Sum()
    up = lambda acc: accum.finish(accum.roll_up(accum.accumulate(df, acc, "l_extendedprice", "l_returnflag", "l_linestatus", "l_linenumber"), acc, "l_returnflag"), acc)
    both = up(m).join(up(s).select("l_returnflag", "sum"), "l_returnflag")
    return both.select("l_returnflag", "n", F.round("mean", 5).alias("mean"), F.round(F.col("var") / 1e6, 6).alias("var"), F.round("skewness", 8).alias("skewness"), F.round("kurtosis", 8).alias("kurtosis"), F.round("sum", 2).alias("sum"))


@query("tdigest_quantiles")
def tdigest_quantiles(spark, sf_dir):
    d = accum.tdigest(lineitem(spark, sf_dir), "l_extendedprice", "l_returnflag")
    return d.select("l_returnflag", F.col("digest.n").alias("n"), *(accum.tdigest_quantile("digest", q).alias(f"q{int(q * 100)}") for q in (0.01, 0.25, 0.5, 0.75, 0.99)), accum.tdigest_cdf("digest", 30000.0).alias("cdf"), accum.quantile_edges("digest", 4).alias("edges"))


@query("tdigest_rank_error", "SELECT l_returnflag, count(*) AS n, true AS within FROM lineitem GROUP BY 1")
def tdigest_rank_error(spark, sf_dir):
    """Whether the ranks of the digest's quantiles are within 0.75 % of what was asked for."""
    df = lineitem(spark, sf_dir)
    qs = (0.05, 0.25, 0.5, 0.75, 0.95)
    d = accum.tdigest(df, "l_extendedprice", "l_returnflag").select("l_returnflag", *(accum.tdigest_quantile("digest", q).alias(f"v{i}") for i, q in enumerate(qs)))
    j = df.join(F.broadcast(d), "l_returnflag")  # one row for each flag
    within = lambda i, q: F.abs(F.avg((F.col("l_extendedprice") <= F.col(f"v{i}")).cast("double")) - q) <= 0.0075
    ok = within(0, qs[0])
    for i, q in enumerate(qs[1:], 1):
        ok = ok & within(i, q)
    return j.groupBy("l_returnflag").agg(F.count("*").alias("n"), ok.alias("within"))
