"""Exact quantiles against sorted lists."""

import math
import random

import numpy as np
import pytest

from quillon.operators import select as S
from quillon.operators.errors import ProbabilityOutOfRange

QS = [0.0, 0.01, 0.25, 0.5, 0.731, 0.99, 1.0]


def check(out, rows, keys):
    want = {}
    for *k, v in rows:
        if v is not None and not math.isnan(v):
            want.setdefault(tuple(k) if keys else (), []).append(v)
    got = {tuple(r[c] for c in keys): (r.n, list(r.q)) for r in out.collect()}
    assert set(got) == set(want)
    for k, x in want.items():
        x = sorted(x)
        n = len(x)
        exact = []
        for q in QS:
            h = q * (n - 1)
            a, b = x[math.floor(h)], x[math.ceil(h)]
            exact.append(a if h == math.floor(h) or a == b else a + (h - math.floor(h)) * (b - a))
        assert got[k][0] == n and got[k][1] == pytest.approx(exact, rel=1e-12, nan_ok=True), k


@pytest.mark.parametrize(("few", "grid"), [(50_000, 256), (60, 32)])
def test_quantiles_of_groups(spark, monkeypatch, few, grid):
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "GRID", grid)
    r = random.Random(5)
    rows = [("even", r.random()) for _ in range(1500)] + [("ties", float(r.choice([1, 2, 2, 2, 9]))) for _ in range(800)] + [("wild", r.choice([-1, 1]) * 10.0 ** r.randint(-200, 200)) for _ in range(900)]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0), (None, 5.0), ("gone", None), ("gone", math.nan), ("same", 3.0), ("same", 3.0), ("ends", math.inf), ("ends", -math.inf), ("ends", 0.0)]
    rows += [("ends2", v) for v in [math.inf] * 50 + [1.0] * 50 + [0.5] * 60]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    check(S.quantiles(df, "v", QS, "k"), rows, ("k",))


def test_quantiles_without_keys_and_edges(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW", 100)
    rows = [(float(v),) for v in np.random.default_rng(3).integers(0, 500, 5000)]
    df = spark.createDataFrame(rows, "v double")
    check(S.quantiles(df, "v", QS), rows, ())
    monkeypatch.setattr(S, "BROADCAST", 0)
    check(S.quantiles(df, "v", QS), rows, ())
    assert S.quantiles(df.where("false"), "v", [0.5]).count() == 0
    for bad in ([], [1.5], [-0.1]):
        with pytest.raises(ProbabilityOutOfRange):
            S.quantiles(df, "v", bad)


@pytest.mark.parametrize("few", [1, 50_000])
def test_describe_keeps_groups_without_values(spark, monkeypatch, few):
    from quillon.operators import descriptive as D

    monkeypatch.setattr(S, "FEW", few)
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), (None, 5.0), ("gone", None)], "k string, v double")
    got = {r.k: r for r in D.describe(df, "v", "k").collect()}
    assert set(got) == {"a", None, "gone"} and (got["a"].q1, got["a"].median, got["a"].q3) == (1.5, 2.0, 3.0)
    assert got["gone"].n == 0 and got["gone"].median is None and got[None].median == 5.0
    one = D.describe(df, "v").first()
    assert one.n == 4 and one.median == 3.0
