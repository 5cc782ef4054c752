"""Queries of the hypothesis tests, effect sizes and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import htest as H
from quillon.plans.descriptive import lineitem, rounded
from quillon.plans.register import Register, betai, gammp, t_p

query = Register()
QUERIES, ORACLES = query.queries, query.oracles

_S = "count({x})::DOUBLE AS n, avg({x}) AS m, var_samp({x}) AS v"
_TWO = "WITH s AS (SELECT count({x}) FILTER ({g} = '{a}')::DOUBLE AS na, count({x}) FILTER ({g} = '{b}')::DOUBLE AS nb, avg({x}) FILTER ({g} = '{a}') AS ma, avg({x}) FILTER ({g} = '{b}') AS mb, var_samp({x}) FILTER ({g} = '{a}') AS va, var_samp({x}) FILTER ({g} = '{b}') AS vb FROM {t})"
_Q = _TWO.format(x="l_quantity", g="l_returnflag", a="A", b="R", t="lineitem")
_POOLED = "(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))"
_WDF = "(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)))"


@query("t_test_one", f"""
    WITH s AS (SELECT l_returnflag, {_S.format(x='l_quantity')} FROM lineitem GROUP BY 1), t AS (SELECT *, (m - 25.4) / sqrt(v / n) AS t FROM s)
    SELECT l_returnflag, round(t, 6) AS statistic, n - 1 AS df, round({t_p('t', '(n - 1)')}, 7) AS p_value, round((m - 25.4) / sqrt(v), 6) AS effect_size FROM t""")
def t_test_one(spark, sf_dir):
    r = H.t_test_one(lineitem(spark, sf_dir), "l_quantity", 25.4, "l_returnflag")
    return r.select("l_returnflag", F.round("statistic", 6).alias("statistic"), "df", F.round("p_value", 7).alias("p_value"), F.round("effect_size", 6).alias("effect_size"))


@query("t_test_welch", f"""{_Q}, t AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, {_WDF} AS df FROM s)
    SELECT round(t, 6) AS statistic, round(df, 4) AS df, round({t_p('t', 'df')}, 7) AS p_value, round((ma - mb) / sqrt({_POOLED}), 6) AS effect_size FROM t""")
def t_test_welch(spark, sf_dir):
    r = H.t_test_two(lineitem(spark, sf_dir), "l_quantity", "l_returnflag", "A", "R", H.VarAssumption.WELCH)
    return r.select(F.round("statistic", 6).alias("statistic"), F.round("df", 4).alias("df"), F.round("p_value", 7).alias("p_value"), F.round("effect_size", 6).alias("effect_size"))


@query("t_test_student", f"""{_Q}, t AS (SELECT *, (ma - mb) / sqrt({_POOLED} * (1 / na + 1 / nb)) AS t, na + nb - 2 AS df FROM s)
    SELECT round(t, 6) AS statistic, df, round({t_p('t', 'df')}, 7) AS p_value, round((ma - mb) / sqrt({_POOLED}), 6) AS effect_size FROM t""")
def t_test_student(spark, sf_dir):
    r = H.t_test_two(lineitem(spark, sf_dir), "l_quantity", "l_returnflag", "A", "R", H.VarAssumption.EQUAL)
    return r.select(F.round("statistic", 6).alias("statistic"), "df", F.round("p_value", 7).alias("p_value"), F.round("effect_size", 6).alias("effect_size"))


@query("t_test_paired", f"""
    WITH s AS (SELECT {_S.format(x='(l_discount - l_tax)')} FROM lineitem), t AS (SELECT *, m / sqrt(v / n) AS t FROM s)
    SELECT round(t, 5) AS statistic, n - 1 AS df, round({t_p('t', '(n - 1)')}, 7) AS p_value, round(m / sqrt(v), 6) AS effect_size FROM t""")
def t_test_paired(spark, sf_dir):
    r = H.t_test_paired(lineitem(spark, sf_dir), "l_discount", "l_tax")
    return r.select(F.round("statistic", 5).alias("statistic"), "df", F.round("p_value", 7).alias("p_value"), F.round("effect_size", 6).alias("effect_size"))


_ANOVA = """WITH g AS (SELECT o_orderpriority AS g, count(*)::DOUBLE AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1),
    a AS (SELECT sum(n * m) / sum(n) AS grand, sum(n) AS nn, count(*)::DOUBLE AS k, sum((n - 1) * v) AS ssw FROM g),
    s AS (SELECT any_value(nn) AS nn, any_value(k) AS k, any_value(ssw) AS ssw, sum(n * (m - grand) * (m - grand)) AS ssb FROM g, a),
    t AS (SELECT *, (ssb / (k - 1)) / (ssw / (nn - k)) AS f FROM s)"""


@query("anova_one_way", f"""{_ANOVA}
    SELECT round(f, 6) AS statistic, k - 1 AS df, nn - k AS df2, round(1 - {betai('((k - 1) / 2)', '((nn - k) / 2)', '((k - 1) * f / (nn - k + (k - 1) * f))')}, 7) AS p_value, round(ssb / (ssb + ssw), 8) AS effect_size FROM t""")
def anova_one_way(spark, sf_dir):
    r = H.anova_one_way(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", "o_orderpriority")
    return r.select(F.round("statistic", 6).alias("statistic"), "df", "df2", F.round("p_value", 7).alias("p_value"), F.round("effect_size", 8).alias("effect_size"))


@query("eta_squared", f"{_ANOVA} SELECT round(ssb / (ssb + ssw), 8) AS eta_squared FROM t")
def eta_squared(spark, sf_dir):
    return rounded(H.eta_squared(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", "o_orderpriority"), 8)


@query("f_test_var", f"""{_TWO.format(x='c_acctbal', g='c_mktsegment', a='BUILDING', b='MACHINERY', t='customer')},
    t AS (SELECT *, va / vb AS f, {betai('((na - 1) / 2)', '((nb - 1) / 2)', '((na - 1) * va / vb / (nb - 1 + (na - 1) * va / vb))')} AS lo FROM s)
    SELECT round(f, 6) AS statistic, na - 1 AS df, round(least(1, 2 * least(lo, 1 - lo)), 7) AS p_value FROM t""")
def f_test_var(spark, sf_dir):
    r = H.f_test_var(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY")
    return r.select(F.round("statistic", 6).alias("statistic"), "df", F.round("p_value", 7).alias("p_value"))


@query("chi2_gof", f"""
    WITH o AS (SELECT l_linenumber, count(*)::DOUBLE AS o FROM lineitem GROUP BY 1), s AS (SELECT sum(pow(o - e, 2) / e) AS x, count(*)::DOUBLE AS k FROM (SELECT o, (SELECT avg(o) FROM o) AS e FROM o))
    SELECT round(x, 6) AS statistic, k - 1 AS df, round(1 - {gammp('((k - 1) / 2)', '(x / 2)', 2000)}, 7) AS p_value FROM s""")
def chi2_gof(spark, sf_dir):
    o = lineitem(spark, sf_dir).groupBy("l_linenumber").agg(F.count("*").alias("o"))
    e = o.crossJoin(F.broadcast(o.agg(F.avg("o").alias("e"))))  # one row
    r = H.chi2_gof(e, "o", "e")
    return r.select(F.round("statistic", 6).alias("statistic"), "df", F.round("p_value", 7).alias("p_value"))


_CHI = """WITH c AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*)::DOUBLE AS o FROM orders GROUP BY 1, 2),
    f AS (SELECT a.r, b.c FROM (SELECT DISTINCT r FROM c) a, (SELECT DISTINCT c FROM c) b),
    e AS (SELECT coalesce(c.o, 0) AS o, (SELECT sum(o) FROM c x WHERE x.r = f.r) * (SELECT sum(o) FROM c x WHERE x.c = f.c) / (SELECT sum(o) FROM c) AS e FROM f LEFT JOIN c ON c.r = f.r AND c.c = f.c),
    s AS (SELECT sum(pow(o - e, 2) / e) AS x, sum(o) AS n, (SELECT count(DISTINCT r) FROM c)::DOUBLE AS r, (SELECT count(DISTINCT c) FROM c)::DOUBLE AS c FROM e)"""


@query("chi2_independence", f"{_CHI} SELECT round(x, 6) AS statistic, (r - 1) * (c - 1) AS df, round(1 - {gammp('((r - 1) * (c - 1) / 2)', '(x / 2)')}, 7) AS p_value, round(sqrt(x / (n * least(r - 1, c - 1))), 8) AS effect_size FROM s")
def chi2_independence(spark, sf_dir):
    r = H.chi2_independence(H.contingency(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority")
    return r.select(F.round("statistic", 6).alias("statistic"), "df", F.round("p_value", 7).alias("p_value"), F.round("effect_size", 8).alias("effect_size"))


@query("cramers_v", f"{_CHI} SELECT round(sqrt(x / (n * least(r - 1, c - 1))), 8) AS cramers_v FROM s")
def cramers_v(spark, sf_dir):
    return rounded(H.cramers_v(H.contingency(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority"), 8)


_Z = repr(H.z_crit(0.95))


@query("cor_test", f"""
    WITH s AS (SELECT corr(l_discount, l_tax) AS r, count(*)::DOUBLE AS n FROM lineitem), t AS (SELECT *, r * sqrt(n - 2) / sqrt(1 - r * r) AS t FROM s)
    SELECT round(t, 6) AS statistic, n - 2 AS df, round({t_p('t', '(n - 2)')}, 7) AS p_value, round(r, 8) AS effect_size, round(tanh(atanh(r) - {_Z} / sqrt(n - 3)), 7) AS ci_lower, round(tanh(atanh(r) + {_Z} / sqrt(n - 3)), 7) AS ci_upper FROM t""")
def cor_test(spark, sf_dir):
    r = H.cor_test(lineitem(spark, sf_dir), "l_discount", "l_tax", H.CorMethod.PEARSON)
    return r.select(F.round("statistic", 6).alias("statistic"), "df", F.round("p_value", 7).alias("p_value"), F.round("effect_size", 8).alias("effect_size"), F.round("ci_lower", 7).alias("ci_lower"), F.round("ci_upper", 7).alias("ci_upper"))


@query("cohen_d", f"{_Q} SELECT round((ma - mb) / sqrt({_POOLED}), 8) AS cohen_d FROM s")
def cohen_d(spark, sf_dir):
    return rounded(H.cohen_d(lineitem(spark, sf_dir), "l_quantity", "l_returnflag", "A", "R"), 8)




@query("ci_mean", "SELECT l_returnflag, round(avg(l_quantity), 8) AS middle, 0.95::DOUBLE AS coverage FROM lineitem GROUP BY 1")
def ci_mean(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    ci = H.ci_mean(df, "l_quantity", 0.95, "l_returnflag")
    s = df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sqrt(F.var_samp("l_quantity") / F.count("*")).alias("se"))
    j = ci.join(s, "l_returnflag").withColumn("t", (F.col("upper") - F.col("lower")) / 2 / F.col("se")).withColumn("p", H.t_two_sided_p(F.col("t"), F.col("n") - 1))
    return j.select("l_returnflag", F.round((F.col("lower") + F.col("upper")) / 2, 8).alias("middle"), F.round(1 - F.col("p"), 9).alias("coverage"))


@query("ci_mean_diff", f"{_Q} SELECT round(ma - mb, 8) AS middle, round(2 * sqrt({_POOLED} * (1 / na + 1 / nb)), 8) AS width_per_t, round(2 * sqrt(va / na + vb / nb), 8) AS welch_width_per_t FROM s")
def ci_mean_diff(spark, sf_dir):
    """The middle, and the widths over the critical values."""
    df = lineitem(spark, sf_dir)
    a, b = (f(df, "l_quantity", "l_returnflag", "A", "R", 0.95) for f in (H.ci_mean_diff, H.ci_mean_diff_welch))
    dofs = [H.t_test_two(df, "l_quantity", "l_returnflag", "A", "R", v).select(H.t_crit(0.95, F.col("df")).alias(f"c{i}")) for i, v in enumerate((H.VarAssumption.EQUAL, H.VarAssumption.WELCH))]
    j = a.crossJoin(b.select(F.col("lower").alias("l2"), F.col("upper").alias("u2"))).crossJoin(dofs[0]).crossJoin(dofs[1])  # one row each
    return j.select(F.round((F.col("lower") + F.col("upper")) / 2, 8).alias("middle"), F.round((F.col("upper") - F.col("lower")) / F.col("c0"), 8).alias("width_per_t"), F.round((F.col("u2") - F.col("l2")) / F.col("c1"), 8).alias("welch_width_per_t"))


@query("ci_proportion", f"""
    WITH s AS (SELECT l_linestatus, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS p, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)
    SELECT l_linestatus, round(p - {_Z} * sqrt(p * (1 - p) / n), 8) AS lower, round(p + {_Z} * sqrt(p * (1 - p) / n), 8) AS upper FROM s""")
def ci_proportion(spark, sf_dir):
    return rounded(H.ci_proportion(lineitem(spark, sf_dir), F.col("l_returnflag") == "A", 0.95, "l_linestatus").drop("level"), 8)


@query("ci_correlation", f"""
    WITH s AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(tanh(atanh(r) - {_Z} / sqrt(n - 3)), 7) AS lower, round(tanh(atanh(r) + {_Z} / sqrt(n - 3)), 7) AS upper FROM s""")
def ci_correlation(spark, sf_dir):
    return rounded(H.ci_correlation(lineitem(spark, sf_dir), "l_quantity", "l_extendedprice", 0.95, "l_returnflag").drop("level"), 7)
