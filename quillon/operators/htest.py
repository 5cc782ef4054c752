"""Hypothesis tests, effect sizes and confidence intervals.

Samples are aggregated once to counts, means and variances; statistics are Column arithmetic on the few rows that are left, and
only p-values and critical values are Arrow functions. Every test gives one row for each group of keys with the columns statistic, df, df2,
p_value, effect, effect_size, ci_lower, ci_upper, ci_level and status ("ok", or why the rest is null).
"""

from __future__ import annotations

import math
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import special as S
from quillon.operators import descriptive as D
from quillon.operators.errors import DomainError, check_level



class VarAssumption(Enum):
    """Equal variances (pooled) or not (Welch). There is no default."""

    EQUAL = "equal"
    WELCH = "welch"


class CorMethod(Enum):
    PEARSON = "pearson"


def _over(a: Column, b: Column) -> Column:
    """a / b by IEEE rules."""
    inf = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
    return F.when(b == 0, inf).otherwise(F.try_divide(a, b))


def t_two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|)."""
    return S.column(lambda t, n: S.betai(n / 2, 0.5, n / (n + t * t)), t, df)


def t_crit(level: float, df: Column) -> Column:
    """The two-sided critical value of Student's t."""

    def crit(n):
        x = S.inv_beta_reg(n / 2, 0.5, 1 - level)
        return (n * (1 / x - 1)) ** 0.5

    return S.column(crit, df)


def z_crit(level: float) -> float:
    return float(math.sqrt(2) * S.erfc_inv(1 - level))


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    return S.column(lambda f, m, n: S.betai(n / 2, m / 2, n / (n + m * f)), f, d1, d2)


def f_cdf(f: Column, d1: Column, d2: Column) -> Column:
    return S.column(lambda f, m, n: S.betai_upper(n / 2, m / 2, n / (n + m * f)), f, d1, d2)


def chi2_sf(chi2: Column, df: Column) -> Column:
    return S.column(lambda x, n: S.gammq(n / 2, x / 2), chi2, df)


def _result(df: DataFrame, keys, ok: Column, status: Column, statistic, dof, p, dof2=None, effect=None, size=None, lower=None, upper=None, level=None) -> DataFrame:
    null = F.lit(None).cast("double")
    pick = lambda c: F.when(ok, c) if c is not None else null
    return df.select(
        *keys, pick(statistic).cast("double").alias("statistic"), pick(dof).cast("double").alias("df"), pick(dof2).cast("double").alias("df2"), pick(p).cast("double").alias("p_value"),
        F.lit(effect).cast("string").alias("effect"), pick(size).cast("double").alias("effect_size"), pick(lower).cast("double").alias("ci_lower"), pick(upper).cast("double").alias("ci_upper"),
        F.lit(level).cast("double").alias("ci_level"), F.when(ok, "ok").otherwise(status).alias("status"),
    )


def _few(n: Column, needed: int) -> Column:
    return F.concat(F.lit(f"needs {needed} observations, got "), n.cast("string"))


def _summary(df: DataFrame, value: Column | str, keys) -> DataFrame:
    x = D.clean(value)
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"))


def t_test_one(df: DataFrame, value: Column | str, mu0: float, *keys: str, level: float = 0.95) -> DataFrame:
    """One-sample t test, with Cohen's d and the interval of the mean."""
    check_level(level)
    s = _summary(df, value, keys)
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    se = F.sqrt(v / n)
    t = _over(m - mu0, se)
    s = s.withColumn("t", F.when(n >= 2, t)).withColumn("crit", t_crit(level, F.col("n") - 1)).withColumn("p", t_two_sided_p(F.col("t"), n - 1.0))
    half = F.col("crit") * se
    return _result(s, keys, n >= 2, _few(n, 2), F.col("t"), n - 1, F.col("p"), effect="cohen_d", size=_over(m - mu0, F.sqrt(v)), lower=m - half, upper=m + half, level=level)


def t_test_paired(df: DataFrame, a: str, b: str, *keys: str, level: float = 0.95) -> DataFrame:
    """One-sample t test of a - b against 0; pairs with a missing side are left out."""
    return t_test_one(df, F.col(a).cast("double") - F.col(b).cast("double"), 0.0, *keys, level=level)


def _two(df: DataFrame, value: str, group: str, a, b, keys) -> DataFrame:
    """n, mean and variance of both samples, from one aggregation."""
    x, g = D.clean(value), F.col(group)
    parts = []
    for name, label in (("a", a), ("b", b)):
        own = F.when(g == F.lit(label), x)
        parts += [F.count(own).alias(f"n{name}"), F.avg(own).alias(f"m{name}"), F.var_samp(own).alias(f"v{name}")]
    return df.where(g.isin(a, b)).groupBy(*keys).agg(*parts)




def _pooled() -> Column:
    na, nb, va, vb = (F.col(c) for c in ("na", "nb", "va", "vb"))
    return ((na - 1) * va + (nb - 1) * vb) / F.nullif(na + nb - 2, F.lit(0))


def t_test_two(df: DataFrame, value: str, group: str, a, b, assumption: VarAssumption, *keys: str, level: float = 0.95) -> DataFrame:
    """Two-sample t test of the samples labelled a and b; d is always on the pooled deviation, the interval follows the assumption."""
    check_level(level)
    s = _two(df, value, group, a, b, keys)
    na, nb, ma, mb, va, vb = (F.col(c) for c in ("na", "nb", "ma", "mb", "va", "vb"))
    ok = (na >= 2) & (nb >= 2)
    if assumption is VarAssumption.EQUAL:
        se, dof = F.sqrt(_pooled() * (1 / F.nullif(na, F.lit(0)) + 1 / F.nullif(nb, F.lit(0)))), (na + nb - 2).cast("double")
    else:
        ra, rb = va / F.nullif(na, F.lit(0)), vb / F.nullif(nb, F.lit(0))
        se = F.sqrt(ra + rb)
        dof = _over((ra + rb) * (ra + rb), ra * ra / F.nullif(na - 1, F.lit(0)) + rb * rb / F.nullif(nb - 1, F.lit(0)))
    s = s.withColumn("se", se).withColumn("dof", F.when(ok, dof)).withColumn("t", F.when(ok, _over(ma - mb, F.col("se"))))
    s = s.withColumn("p", t_two_sided_p(F.col("t"), F.col("dof"))).withColumn("half", t_crit(level, F.col("dof")) * F.col("se"))
    diff = ma - mb
    return _result(s, keys, ok, _few(F.least(na, nb), 2), F.col("t"), F.col("dof"), F.col("p"), effect="cohen_d", size=_over(diff, F.sqrt(_pooled())), lower=diff - F.col("half"), upper=diff + F.col("half"), level=level)


def cohen_d(df: DataFrame, value: str, group: str, a, b, *keys: str) -> DataFrame:
    """keys, cohen_d on the pooled deviation."""
    s = _two(df, value, group, a, b, keys)
    return s.select(*keys, F.when((F.col("na") >= 2) & (F.col("nb") >= 2), _over(F.col("ma") - F.col("mb"), F.sqrt(_pooled()))).alias("cohen_d"))


def _between(df: DataFrame, value: str, group: str, keys) -> DataFrame:
    """k, N, least group size, SSB and SSW of each key."""
    g = _summary(df, value, (*keys, group)).where("n > 0")
    per = g.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum("n").alias("N"), F.min("n").alias("least"), F.sum(F.coalesce(F.col("v") * (F.col("n") - 1), F.lit(0.0))).alias("ssw"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
    )
    # second pass over the group table, so that large means don't cancel
    joined = g.join(per.select(*keys, "grand"), list(keys)) if keys else g.crossJoin(F.broadcast(per.select("grand")))  # one row
    ssb = joined.groupBy(*keys).agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))).alias("ssb"))
    return per.join(ssb, list(keys)) if keys else per.crossJoin(F.broadcast(ssb))  # one row each


def anova_one_way(df: DataFrame, value: str, group: str, *keys: str) -> DataFrame:
    """F test of equal means, with eta squared; two groups at least, of two observations at least."""
    s = _between(df, value, group, keys)
    k, n = F.col("k"), F.col("N")
    d1, d2 = (k - 1).cast("double"), (n - k).cast("double")
    ok = (k >= 2) & (F.col("least") >= 2)
    f = _over(F.col("ssb") / F.nullif(d1, F.lit(0.0)), F.col("ssw") / F.nullif(d2, F.lit(0.0)))
    s = s.withColumn("f", F.when(ok, f)).withColumn("p", f_sf(F.col("f"), d1, d2))
    return _result(s, keys, ok, F.lit("needs two groups of two observations"), F.col("f"), d1, F.col("p"), dof2=d2, effect="eta_squared", size=_over(F.col("ssb"), F.col("ssb") + F.col("ssw")))


def eta_squared(df: DataFrame, value: str, group: str, *keys: str) -> DataFrame:
    s = _between(df, value, group, keys)
    return s.select(*keys, _over(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta_squared"))


def f_test_var(df: DataFrame, value: str, group: str, a, b, *keys: str) -> DataFrame:
    """Ratio of two variances; p is twice the smaller tail, each tail computed itself."""
    s = _two(df, value, group, a, b, keys)
    na, nb = F.col("na"), F.col("nb")
    ok = (na >= 2) & (nb >= 2)
    d1, d2 = (na - 1).cast("double"), (nb - 1).cast("double")
    s = s.withColumn("f", F.when(ok, _over(F.col("va"), F.col("vb")))).withColumn("lo", f_cdf(F.col("f"), d1, d2)).withColumn("hi", f_sf(F.col("f"), d1, d2))
    # least() would take the tail that isn't NaN
    p = F.when(F.isnan("lo") | F.isnan("hi"), F.lit(math.nan)).otherwise(F.least(F.lit(1.0), 2 * F.least("lo", "hi")))
    return _result(s, keys, ok, _few(F.least(na, nb), 2), F.col("f"), d1, p)


def chi2_gof(df: DataFrame, observed: str, expected: str, *keys: str) -> DataFrame:
    """Goodness of fit over one row for each category; an expected count that isn't positive gives NaN."""
    o, e = F.col(observed).cast("double"), F.col(expected).cast("double")
    term = F.when(e > 0, (o - e) * (o - e) / F.nullif(e, F.lit(0.0))).otherwise(F.lit(math.nan))
    s = df.groupBy(*keys).agg(F.sum(term).alias("x"), F.count("*").alias("k"))
    dof = (F.col("k") - 1).cast("double")
    s = s.withColumn("p", chi2_sf(F.col("x"), dof))
    return _result(s, keys, F.col("k") >= 2, _few(F.col("k"), 2), F.col("x"), dof, F.col("p"))


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, n): counts of the cells that occur."""
    return df.groupBy(row, col).agg(F.count("*").alias("n"))


def _chi2(table: DataFrame, row: str, col: str, n: str) -> DataFrame:
    """x, total, r, c of a table of counts; cells that don't occur add their expected count."""
    t = table.groupBy(row, col).agg(F.sum(F.col(n).cast("double")).alias("o"))
    t = t.withColumn("rs", F.sum("o").over(Window.partitionBy(row))).withColumn("cs", F.sum("o").over(Window.partitionBy(col)))
    whole = t.agg(F.sum("o").alias("total"), F.countDistinct(row).alias("r"), F.countDistinct(col).alias("c"))
    j = t.crossJoin(F.broadcast(whole))  # one row
    e = F.col("rs") * F.col("cs") / F.nullif(F.col("total"), F.lit(0.0))
    # sum over all cells of (o - e)^2 / e = sum over occurring cells of o^2 / e - total
    part = F.when(e > 0, (F.col("o") - e) * (F.col("o") - e) / F.nullif(e, F.lit(0.0)) - e)
    got = j.agg(F.sum(part).alias("s"), F.first("total").alias("total"), F.first("r").alias("r"), F.first("c").alias("c"))
    return got.select((F.col("s") + F.col("total")).alias("x"), "total", "r", "c")


def chi2_independence(table: DataFrame, row: str, col: str, n: str = "n") -> DataFrame:
    """Pearson's test over a long table of counts, without Yates's correction, and Cramer's V."""
    s = _chi2(table, row, col, n)
    dof = ((F.col("r") - 1) * (F.col("c") - 1)).cast("double")
    ok = (F.col("r") >= 2) & (F.col("c") >= 2)
    s = s.withColumn("p", chi2_sf(F.col("x"), dof))
    return _result(s, (), ok, F.lit("needs two rows and two columns"), F.col("x"), dof, F.col("p"), effect="cramers_v", size=_cramer())


def _cramer() -> Column:
    return F.sqrt(_over(F.col("x"), F.col("total") * (F.least("r", "c") - 1)))


def cramers_v(table: DataFrame, row: str, col: str, n: str = "n") -> DataFrame:
    return _chi2(table, row, col, n).select(F.when((F.col("r") >= 2) & (F.col("c") >= 2), _cramer()).alias("cramers_v"))


def cor_test(df: DataFrame, a: str, b: str, method: CorMethod, *keys: str, level: float = 0.95) -> DataFrame:
    """Test of no correlation; the interval is Fisher's, null for three pairs."""
    if method is not CorMethod.PEARSON:
        raise DomainError("only Pearson's correlation")
    check_level(level)
    x, _ = D._paired(a, b)
    s = df.groupBy(*keys).agg(F.count(x).alias("n"), D.pearson(a, b).alias("r"))
    n, r = F.col("n"), F.col("r")
    dof = (n - 2).cast("double")
    s = s.withColumn("t", F.when(n >= 3, _over(r * F.sqrt(dof), F.sqrt(1 - r * r)))).withColumn("p", t_two_sided_p(F.col("t"), dof))
    lower, upper = _fisher(r, n, level)
    return _result(s, keys, n >= 3, _few(n, 3), F.col("t"), dof, F.col("p"), effect="r", size=r, lower=lower, upper=upper, level=level)


def _fisher(r: Column, n: Column, level: float) -> tuple[Column, Column]:
    z = F.atanh(r)
    half = z_crit(level) / F.sqrt(F.nullif(n - 3, F.lit(0)).cast("double"))
    return F.when(n >= 4, F.tanh(z - half)), F.when(n >= 4, F.tanh(z + half))


def _interval(df: DataFrame, keys, middle: Column, half: Column, level: float) -> DataFrame:
    return df.select(*keys, (middle - half).alias("lower"), (middle + half).alias("upper"), F.lit(level).alias("level"))


def ci_mean(df: DataFrame, value: str, level: float, *keys: str) -> DataFrame:
    """Student's interval of the mean."""
    s = _summary(df, value, keys).withColumn("crit", t_crit(check_level(level), F.col("n") - 1))
    return _interval(s, keys, F.col("m"), F.col("crit") * F.sqrt(F.col("v") / F.col("n")), level)


def ci_mean_diff(df: DataFrame, value: str, group: str, a, b, level: float, *keys: str, welch: bool = False) -> DataFrame:
    """Interval of a difference of means: pooled, or Welch's."""
    t = t_test_two(df, value, group, a, b, VarAssumption.WELCH if welch else VarAssumption.EQUAL, *keys, level=level)
    return t.select(*keys, F.col("ci_lower").alias("lower"), F.col("ci_upper").alias("upper"), F.lit(level).alias("level"))


def ci_mean_diff_welch(df: DataFrame, value: str, group: str, a, b, level: float, *keys: str) -> DataFrame:
    return ci_mean_diff(df, value, group, a, b, level, *keys, welch=True)


def ci_proportion(df: DataFrame, success: Column, level: float, *keys: str) -> DataFrame:
    """Wald's interval of a share, not held to [0, 1]."""
    z = z_crit(check_level(level))
    s = df.groupBy(*keys).agg(F.count(success).alias("n"), F.avg(success.cast("double")).alias("p"))
    return _interval(s, keys, F.col("p"), z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")), level)


def ci_correlation(df: DataFrame, a: str, b: str, level: float, *keys: str) -> DataFrame:
    """Fisher's interval of a correlation; four pairs at least."""
    x, _ = D._paired(a, b)
    s = df.groupBy(*keys).agg(F.count(x).alias("n"), D.pearson(a, b).alias("r"))
    lower, upper = _fisher(F.col("r"), F.col("n"), check_level(level))
    return s.select(*keys, lower.alias("lower"), upper.alias("upper"), F.lit(level).alias("level"))
