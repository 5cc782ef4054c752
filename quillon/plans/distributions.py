"""A query for each distribution: cdf, sf, density or mass on a grid, and probabilities taken to quantiles and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import dist
from quillon.plans.descriptive import lineitem
from quillon.plans.register import Register, betai, gammp, phi

query = Register()
QUERIES, ORACLES = query.queries, query.oracles

_T = "(x * x / (7 + x * x))"
#: name: distribution, SQL of its cdf and of its density or mass at x.
CASES = {
    "normal": (dist.Normal(2.5, 1.2), phi("((x - 2.5) / 1.2)"), "exp(-0.5 * pow((x - 2.5) / 1.2, 2)) / (1.2 * sqrt(2 * pi()))"),
    "student_t": (dist.StudentT(7.0), f"(0.5 + 0.5 * {betai('0.5', '3.5', _T)})", "exp(lgamma(4) - lgamma(3.5)) / sqrt(7 * pi()) * pow(1 + x * x / 7, -4)"),
    "chi_squared": (dist.ChiSquared(5.0), gammp("2.5", "(x / 2)"), "pow(x, 1.5) * exp(-x / 2) / (pow(2, 2.5) * exp(lgamma(2.5)))"),
    "fisher_f": (dist.FisherF(6.0, 12.0), betai("3.0", "6.0", "(6 * x / (12 + 6 * x))"), "exp(3 * ln(0.5) + 2 * ln(x) - 9 * ln(1 + x / 2) + lgamma(9) - lgamma(3) - lgamma(6))"),
    "uniform": (dist.Uniform(-1.0, 6.0), "((x + 1) / 7)", "1 / 7.0"),
    "exponential": (dist.Exponential(1.5), "(1 - exp(-1.5 * x))", "1.5 * exp(-1.5 * x)"),
    "cauchy": (dist.Cauchy(1.0, 2.0), "(0.5 + atan((x - 1) / 2) / pi())", "1 / (2 * pi() * (1 + pow((x - 1) / 2, 2)))"),
    "weibull": (dist.Weibull(2.0, 1.5), "(1 - exp(-pow(x / 1.5, 2)))", "2 / 1.5 * (x / 1.5) * exp(-pow(x / 1.5, 2))"),
    "log_normal": (dist.LogNormal(0.5, 0.75), phi("((ln(x) - 0.5) / 0.75)"), "exp(-0.5 * pow((ln(x) - 0.5) / 0.75, 2)) / (x * 0.75 * sqrt(2 * pi()))"),
    "gamma": (dist.Gamma(3.5, 2.0), gammp("3.5", "(2 * x)"), "exp(3.5 * ln(2) + 2.5 * ln(x) - 2 * x - lgamma(3.5))"),
    "beta": (dist.Beta(2.5, 4.0), betai("2.5", "4.0", "(x / 5.1)"), "exp(lgamma(6.5) - lgamma(2.5) - lgamma(4) + 1.5 * ln(x / 5.1) + 3 * ln(1 - x / 5.1))"),
    "inverse_gaussian": (dist.InverseGaussian(1.5, 2.0), f"({phi('(sqrt(2 / x) * (x / 1.5 - 1))')} + exp(4 / 1.5) * {phi('(-sqrt(2 / x) * (x / 1.5 + 1))')})", "sqrt(2 / (2 * pi() * x * x * x)) * exp(-2 * pow(x - 1.5, 2) / (2 * 1.5 * 1.5 * x))"),
    "bernoulli": (dist.Bernoulli(0.4), "(CASE WHEN k >= 1 THEN 1.0 ELSE 0.6 END)", "CASE WHEN k = 1 THEN 0.4 WHEN k = 0 THEN 0.6 ELSE 0 END"),
    "binomial": (dist.Binomial(60, 0.35), "list_sum([exp(lgamma(61) - lgamma(j + 1) - lgamma(61 - j) + j * ln(0.35) + (60 - j) * ln(0.65)) FOR j IN range(0, k::INT + 1)])", "exp(lgamma(61) - lgamma(k + 1) - lgamma(61 - k) + k * ln(0.35) + (60 - k) * ln(0.65))"),
    "poisson": (dist.Poisson(14.5), "list_sum([exp(j * ln(14.5) - 14.5 - lgamma(j + 1)) FOR j IN range(0, k::INT + 1)])", "exp(k * ln(14.5) - 14.5 - lgamma(k + 1))"),
    "geometric": (dist.Geometric(0.1), "(1 - pow(0.9, k))", "0.1 * pow(0.9, k - 1)"),
    "neg_binomial": (dist.NegBinomial(4.0, 0.8), "list_sum([exp(lgamma(j + 4) - lgamma(j + 1) - lgamma(4) + 4 * ln(0.2) + j * ln(0.8)) FOR j IN range(0, k::INT + 1)])", "exp(lgamma(k + 4) - lgamma(k + 1) - lgamma(4) + 4 * ln(0.2) + k * ln(0.8))"),
    "hypergeometric": (dist.Hypergeometric(200, 60, 50), "list_sum([exp(lgamma(61) - lgamma(j + 1) - lgamma(61 - j) + lgamma(141) - lgamma(51 - j) - lgamma(91 + j) - lgamma(201) + lgamma(51) + lgamma(151)) FOR j IN range(0, k::INT + 1)])", "exp(lgamma(61) - lgamma(k + 1) - lgamma(61 - k) + lgamma(141) - lgamma(51 - k) - lgamma(91 + k) - lgamma(201) + lgamma(51) + lgamma(151))"),
}


def _register(name: str, d: dist.Distribution, cdf: str, density: str) -> None:
    scale = 51.0 if name == "beta" else 10.0
    sql = f"""
    WITH g AS (SELECT q, q AS k, q / 10.0 AS x FROM (SELECT DISTINCT l_quantity AS q FROM lineitem))
    SELECT q, round({cdf}, 9)::DOUBLE AS cdf, round(1 - {cdf}, 9)::DOUBLE + 0.0 AS sf, round({density}, 9)::DOUBLE AS {'mass' if d.discrete else 'density'}, {'true AS back' if d.discrete else 'round(q / 51.0, 8)::DOUBLE AS back'} FROM g"""

    def run(spark, sf_dir):
        q = F.col("q")
        x = q if d.discrete else q / scale
        u = q / 51
        grid = lineitem(spark, sf_dir).select(F.col("l_quantity").alias("q")).distinct()
        if d.discrete:
            # the quantile is the least k whose cdf reaches u
            grid = grid.withColumn("k", d.quantile(u))
            back = ((d.cdf(F.col("k")) >= u) & (d.cdf(F.col("k") - 1) < u)).alias("back")
            return grid.select("q", F.round(d.cdf(x), 9).alias("cdf"), F.round(d.sf(x), 9).alias("sf"), F.round(d.mass(x), 9).alias("mass"), back)
        return grid.select("q", F.round(d.cdf(x), 9).alias("cdf"), F.round(d.sf(x), 9).alias("sf"), F.round(d.density(x), 9).alias("density"), F.round(d.cdf(d.quantile(u)), 8).alias("back"))

    query(f"dist_{name}", sql)(run)


for _name, _case in CASES.items():
    _register(_name, *_case)


@query("dist_studentized_range")
def dist_studentized_range(spark, sf_dir):
    """cdf and sf for three groups and twelve degrees of freedom."""
    d = dist.StudentizedRange(3.0, 12.0)
    x = F.col("q") / 10
    return lineitem(spark, sf_dir).select(F.col("l_quantity").alias("q")).distinct().select("q", F.round(d.cdf(x), 8).alias("cdf"), F.round(d.sf(x), 8).alias("sf"), F.round(d.density(x), 8).alias("density"))


@query("dist_moments")
def dist_moments(spark, sf_dir):
    """Mean, variance, skewness, kurtosis and entropy of every case; null where undefined."""
    rows = [(n, d.mean(), d.variance(), d.skewness(), d.kurtosis(), d.entropy()) for n, (d, *_) in CASES.items()]
    return spark.createDataFrame([(n, *(None if v is None else float(v) for v in r)) for n, *r in rows], "name string, mean double, variance double, skewness double, kurtosis double, entropy double")


@query("dist_samples")
def dist_samples(spark, sf_dir):
    """Means of 2,000 draws of the cases whose quantile is a closed form or a short search."""
    out = None
    for n in ("normal", "uniform", "exponential", "weibull", "log_normal", "bernoulli", "geometric"):
        d = CASES[n][0]
        if d.mean() is not None:
            one = d.sample(spark, 2000, 3, 2).agg(F.lit(n).alias("name"), F.avg("value").alias("mean"), F.lit(float(d.mean())).alias("expected"))
            out = one if out is None else out.unionByName(one)
    return out
