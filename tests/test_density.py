import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import density as K
from quillon.operators.errors import DomainError


def table(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double").repartition(5)


def direct(x, h, at):
    x = np.asarray(x)[np.isfinite(x)]
    return np.exp(-0.5 * ((at - x) / h) ** 2).sum() / math.sqrt(2 * math.pi)


def values(case):
    r = np.random.default_rng(3)
    return {
        "normal": r.normal(0, 1, 800), "far": 1e9 + r.normal(0, 2, 500), "skewed": r.exponential(50, 600), "ties": np.repeat([1.0, 2.0, 2.5], [700, 3, 1]), "two_heaps": np.concatenate((r.normal(-500, 1, 300), r.normal(500, 1, 300))),
    }[case].tolist()


@pytest.mark.parametrize("case", ["normal", "far", "skewed", "ties", "two_heaps"])
@pytest.mark.parametrize("error", [1e-2, 1e-6, 1e-11])
def test_stated_error_is_met(spark, case, error):
    x, h = values(case), 0.7
    lo, hi = min(x) - 8, max(x) + 8
    grid = [lo + (hi - lo) * i / 60 for i in range(61)] + x[:20]
    fit = K.kde(table(spark, x), "x", K.Kernel.GAUSSIAN, K.Bandwidth("fixed", h))
    got = {r.g: r.density for r in fit.evaluate(table(spark, grid, "g"), "g", error).collect()}
    assert len(got) == len(set(grid))
    bound = error / (h * math.sqrt(2 * math.pi)) + 1e-13
    worst = max(abs(got[g] - direct(x, h, g) / (len(x) * h)) for g in got)
    assert worst <= bound and min(got.values()) >= 0


def test_terms_follow_the_bound():
    assert [K._terms(e) for e in (0.5, 1e-3, 1e-6)] == sorted(K._terms(e) for e in (0.5, 1e-3, 1e-6))
    for e in (1e-2, 1e-5, 1e-9):
        left = lambda p: sum(1.09 * 0.5**q / math.sqrt(math.factorial(q)) for q in range(p, 60))
        assert left(K._terms(e)) <= e < left(K._terms(e) - 1)


def test_many_points_in_one_cell_and_repeated_points(spark):
    x = np.random.default_rng(1).normal(0, 1, 300).tolist()
    fit = K.kde(table(spark, x), "x", K.Kernel.GAUSSIAN, K.Bandwidth("fixed", 1.0))
    grid = spark.range(3000).select((F.col("id") / 30_000).alias("g"))  # all within a tenth of a cell
    got = fit.evaluate(grid.unionByName(grid), "g").collect()
    assert len(got) == 3000
    assert max(abs(r.density - direct(x, 1.0, r.g) / 300) for r in got[::50]) < 1e-10


def test_both_ways_agree_and_a_large_grid_needs_no_broadcast(spark, monkeypatch):
    x = values("normal")
    fit = K.kde(table(spark, x), "x", K.Kernel.GAUSSIAN, K.SILVERMAN)
    grid = table(spark, [i / 10 for i in range(-50, 51)], "g")
    by_moments, by_values = ({r.g: r.density for r in fit.evaluate(grid, "g", e).collect()} for e in (K.ERROR, 0.0))
    assert max(abs(by_moments[g] - by_values[g]) for g in by_values) < 1e-10
    monkeypatch.setattr(K, "LARGEST_GRID", 10)
    assert fit.evaluate(grid, "g").count() == 101
    with pytest.raises(DomainError):
        fit.evaluate(grid, "g", 0.0)
    with pytest.raises(DomainError):
        fit.evaluate(grid, "g", 1.0)


def test_defined_results(spark):
    inf, nan = float("inf"), float("nan")
    fit = K.kde(table(spark, [0.0, 1.0, inf, -inf, None, nan]), "x", K.Kernel.GAUSSIAN, K.Bandwidth("fixed", 1.0))
    assert fit.n == 4  # infinite values count, and give nothing anywhere
    got = {str(r.g): r.density for r in fit.evaluate(table(spark, [0.0, inf, -inf, nan, None, 1e300, -0.0], "g"), "g").collect()}
    assert got["0.0"] == pytest.approx((1 + math.exp(-0.5)) / math.sqrt(2 * math.pi) / 4, rel=1e-10)
    assert all(got[k] == 0 for k in ("inf", "-inf", "nan", "None", "1e+300")) and len(got) == 6
    assert fit.evaluate(table(spark, [], "g"), "g").collect() == []
    wide = K.kde(table(spark, [0.0, 1.0, 1e30]), "x", K.Kernel.GAUSSIAN, K.Bandwidth("fixed", 1.0))  # more than 2^40 widths
    assert wide.evaluate(table(spark, [1e30], "g"), "g").first().density == pytest.approx(1 / math.sqrt(2 * math.pi) / 3, rel=1e-12)
