import math
import random

import pytest

from quillon.operators.descriptive import logsumexp


def expected(xs):
    m = max(xs)
    return m + math.log(math.fsum(math.exp(x - m) for x in xs))


def test_groups_against_the_formula(spark):
    r = random.Random(2)
    data = {
        "plain": [r.gauss(0, 3) for _ in range(500)], "high": [r.uniform(5000, 9000) for _ in range(100)], "low": [r.uniform(-9000, -5000) for _ in range(100)], "near_zero": [-0.1], "border": [255.9, 256.1, 256.0, -256.0],
        "below": [256.0 + 1e-9] + [255.999] * 200, "spread": [-1e300, -3.0, 1e5], "huge": [1e300, 1e300], "copies": [1000.0] * 400,
    }
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs] + [("plain", None), ("plain", float("-inf"))], "g string, x double").repartition(6)
    got = {q.g: q.lse for q in logsumexp(df, "x", "g").collect()}
    assert got.keys() == data.keys()
    for g, xs in data.items():
        assert got[g] == pytest.approx(expected(xs), rel=1e-13, abs=1e-12), g


def test_defined_results(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", -inf), ("a", -inf), ("b", None), ("c", inf), ("c", 1.0), ("d", nan), ("d", 1.0), ("e", nan), ("e", -inf), (None, 2.0)], "g string, x double")
    got = {q.g: q.lse for q in logsumexp(df, "x", "g").collect()}
    assert got["a"] == got["b"] == got["e"] == -inf and math.isnan(got["c"]) and math.isnan(got["d"]) and got[None] == 2.0
    assert [q.lse for q in logsumexp(df.where("g = ''"), "x").collect()] == [-inf] and logsumexp(df.where("g = ''"), "x", "g").collect() == []
