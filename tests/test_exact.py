import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillon.operators import exact as X


def groups():
    r = random.Random(5)
    wide = [r.choice((-1, 1)) * r.random() * 2.0 ** r.randint(-1074, 1020) for _ in range(400)]
    mid = [r.choice((-1, 1)) * r.random() * 2.0 ** r.randint(-60, 60) for _ in range(500)]
    out = {
        "wide": wide, "mid": mid, "cancel": [*mid, *(-x for x in mid[1:])], "none": [*mid, *(-x for x in mid)], "tiny": [r.choice((-1, 1)) * 5e-324 * r.randint(1, 10**6) for _ in range(50)],
        "subnormal": [2.0**-1022, -5e-324], "borders": [s * (2.0**e + d) for e in range(-64, 97, 32) for d in (0.0, 2.0 ** (e - 52), -(2.0 ** (e - 53))) for s in (1, 1, -1)],
        "ties": [1.0, 2.0**-53], "over_tie": [1.0, 2.0**-53, 2.0**-1000], "under_tie": [1.0, 2.0**-53, -(2.0**-1000)], "ties_odd": [1.0 + 2.0**-52, 2.0**-53], "top": [1.7976931348623157e308], "top_and_back": [1.7976931348623157e308, 1.7976931348623157e308, -1.7976931348623157e308],
        "small_border": [2.0**-400, -(2.0**-400) * (1 - 2.0**-53), 2.0**-401], "zeros": [0.0, -0.0, 0.0], "one": [-0.1], "copies": [0.1] * 3000,
    }
    for i in range(60):
        out[f"r{i}"] = [math.ldexp(r.uniform(-1, 1), r.randint(-120, 120)) for _ in range(r.randint(1, 30))]
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(g, x) for g, xs in groups().items() for x in xs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([*rows, ("mid", None), ("mid", float("nan")), ("missing", None), (None, 2.5)], "g string, x double").repartition(7)


def test_sums_are_correctly_rounded(table):
    got = {r.g: (r.n, r["sum"]) for r in X.sums(table, "x", "g").collect()}
    assert got.pop(None) == (1, 2.5) and "missing" not in got
    for g, xs in groups().items():
        assert got[g] == (len(xs), float(sum(map(Fraction, xs)))), g
    assert len(got) == len(groups())


def test_same_bits_under_any_partitioning_and_by_states(spark, table):
    want = sorted(map(tuple, X.sums(table.where("g is not null"), "x", "g").collect()))
    assert sorted(map(tuple, X.sums(table.where("g is not null").repartition(3, "x"), "x", "g").collect())) == want
    halves = X.states(table.where("x > 0"), "x", "g").unionByName(X.states(table.where("x <= 0 or x is null"), "x", "g"))
    whole = {r["_g"]: (r.n, r["sum"]) for r in X.finish(X.roll_up(halves)).collect()}
    assert {f'{{"g":"{g}"}}': (n, s) for g, n, s in want}.items() <= whole.items()


def test_no_python_worker(table):
    plan = X.sums(table, "x", "g")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_not_finite_overflow_and_empty(spark):
    inf = float("inf")
    df = spark.createDataFrame([("p", inf), ("p", 1.0), ("m", -inf), ("m", 5.0), ("both", inf), ("both", -inf), ("over", 1.7e308), ("over", 1.7e308)], "g string, x double")
    got = {r.g: r["sum"] for r in X.sums(df, "x", "g").collect()}
    assert got["p"] == inf and got["m"] == -inf and math.isnan(got["both"]) and got["over"] == inf
    assert X.sums(df.where("g = ''"), "x", "g").collect() == [] and X.sums(df.where("g = ''"), "x").collect() == []
    assert [tuple(r) for r in X.sums(df.where("g = 'm' and x > 0"), "x").collect()] == [(1, 5.0)]


def test_two_pass_variance(spark):
    r = random.Random(8)
    data = {"far": [1e9 + r.random() for _ in range(300)], "flat": [0.1] * 50, "one": [3.0], "two": [1.0, 2.0], "plain": [r.gauss(0, 1) for _ in range(200)]}
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs] + [("odd", float("inf")), ("odd", 1.0), ("plain", None)], "g string, x double").repartition(5)
    got = {q.g: q for q in X.two_pass(df, "x", "g").collect()}
    for g, xs in data.items():
        n, m = len(xs), sum(map(Fraction, xs)) / len(xs)
        assert got[g].n == n and got[g].mean == pytest.approx(float(m), rel=1e-15)
        if n == 1:
            assert got[g]["var"] is None
        else:
            assert got[g]["var"] == pytest.approx(float(sum((Fraction(x) - m) ** 2 for x in xs) / (n - 1)), rel=1e-13, abs=1e-30)
    assert math.isnan(got["odd"]["var"]) and got["odd"].n == 2
    assert sorted(map(str, X.two_pass(df.repartition(2), "x", "g").collect())) == sorted(map(str, got.values()))
    assert X.two_pass(df.where("x is null"), "x").collect() == []
    assert X.two_pass(df.where(F.col("g") == "two"), "x").first()["var"] == 0.5
