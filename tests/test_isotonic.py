"""Monotone means in windows against the greatest of the least means."""

import math

import numpy as np
import pytest

from quillon.operators import isotonic as I
from quillon.operators import transform as T


def brute(s, c):
    s0, c0 = np.concatenate([[0.0], np.cumsum(s)]), np.concatenate([[0.0], np.cumsum(c)])
    least = lambda j, i: min((s0[k + 1] - s0[j]) / (c0[k + 1] - c0[j]) for k in range(i, len(s)))
    return np.array([max(least(j, i) for j in range(i + 1)) for i in range(len(s))])


def _cases():
    g = np.random.default_rng(5)
    yield "noise", np.arange(60), g.normal(size=60) + np.arange(60) / 20, g.integers(1, 5, 60)
    yield "falling", np.arange(50), -np.arange(50.0), np.ones(50)
    yield "rising", np.arange(40), np.arange(40.0), np.ones(40)
    yield "a heavy low end", np.arange(45), np.append(np.arange(44.0), -50.0), np.append(np.ones(44), 100)
    yield "ties", np.arange(30), np.repeat([2.0, 1.0, 3.0], 10), np.ones(30)
    yield "gaps", np.sort(g.choice(np.arange(3, 95), 35, replace=False)), g.normal(size=35), np.ones(35)
    yield "one", np.array([4]), np.array([1.5]), np.array([2.0])


@pytest.mark.parametrize("name, at, mean, c", list(_cases()))
def test_windows(spark, name, at, mean, c):
    n = int(at[-1]) + 6
    sums = spark.createDataFrame([(int(i), float(m * k), float(k)) for i, m, k in zip(at, mean, c, strict=True)], "at long, s double, c double").repartition(3)
    want = np.interp(np.arange(n), at, brute(mean * c, c))
    for window in (8, 1000):
        got = I.monotone(sums, n, window).orderBy("at").collect()
        assert [r.at for r in got] == list(range(n))
        np.testing.assert_allclose([r.fitted for r in got], want, rtol=0, atol=1e-12)


def test_windows_hold_few_pools(spark):
    """No window has more pools than it may, whatever the places are."""
    sums = spark.createDataFrame([(i * i, float(i % 17), 1.0) for i in range(100)], "at long, s double, c double")
    found = I.pools(sums, 8)
    assert max(r["count"] for r in found.groupBy("w").count().collect()) <= 8
    assert found.selectExpr("sum(c)").first()[0] == 100


def test_no_place_has_a_value(spark):
    empty = spark.createDataFrame([], "at long, s double, c double")
    assert all(math.isnan(r.fitted) for r in I.monotone(empty, 3).collect())
    df = spark.createDataFrame([("a", 1, math.inf), ("a", 2, -math.inf), ("b", 1, None), ("b", 2, None)], "col string, row int, value double")
    got = {(r.col, r.row): r.value for r in T.quantile_normalize(df, "col", "row", "value", T.Infinities.AS_EXTREMES).collect()}
    assert got[("a", 1)] == math.inf and got[("a", 2)] == -math.inf and got[("b", 1)] is None


def test_target_by_windows(spark, monkeypatch):
    """An incomplete table gives the same in many windows as in one."""
    g = np.random.default_rng(9)
    rows = [(c, r, float(np.round(g.normal(), 1))) for c in range(4) for r in range(60) if g.random() > 0.3 * c / 3]
    df = spark.createDataFrame(rows, "col int, row int, value double")
    whole = {(r.col, r.row): r.value for r in T.quantile_normalize(df, "col", "row", "value").collect()}
    monkeypatch.setattr(I, "WINDOW", 8)
    parts = {(r.col, r.row): r.value for r in T.quantile_normalize(df, "col", "row", "value").collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-12 for k in whole)
