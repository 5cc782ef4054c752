"""Histograms with a million given edges, and equal bins without a list of edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import density as K
from quillon.operators.errors import DomainError


def test_a_million_edges(spark):
    g = np.random.default_rng(3)
    edges = np.unique(np.concatenate([g.normal(size=999_990), g.normal(size=10) * 1e6]))  # nearly all lie close together
    x = np.concatenate([g.normal(size=3000) * 2, edges[:5], edges[-3:], [edges[-1] * 2, math.inf, -math.inf]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,)], "x double").repartition(3)
    got = K.histogram_auto(df, "x", K.Bins(edges=tuple(edges.tolist())), K.Norm.COUNT).where("value > 0").orderBy("bin").collect()
    want, _ = np.histogram(x[np.isfinite(x)], edges)
    at = np.flatnonzero(want)
    assert [(r.bin, r.value, r.lower, r.upper) for r in got] == [(i, want[i], edges[i], edges[i + 1]) for i in at]


def test_too_many_edges(spark, monkeypatch):
    monkeypatch.setattr(K, "LARGEST_EDGES", 2)
    with pytest.raises(DomainError):
        K.histogram_auto(spark.range(3), "id", K.Bins(edges=(0.0, 1.0, 2.0)), K.Norm.COUNT)


def test_many_equal_bins(spark):
    df = spark.range(1000).select(F.sqrt("id").alias("x"))
    got = K.histogram_auto(df, "x", K.Bins(count=100_000), K.Norm.COUNT)
    low = got.orderBy("bin").collect()
    top = math.sqrt(999)
    assert len(low) == 100_000 and low[0].lower == 0 and low[-1].upper == top and sum(r.value for r in low) == 1000
    assert all(r.lower == r.bin * top / 100_000 for r in low)
