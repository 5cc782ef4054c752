"""Operators whose groups don't meet in one task: global ranks, and inference on tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from quillon.operators import graph as G
from quillon.operators import nulls as N
from quillon.operators import order as O
from quillon.operators import permute as P
from quillon.operators import transform as X
from quillon.operators.tfce import InvalidParams, Tail, resolve_params, tfce_map


def ranked_rows(n=3000, seed=1):
    r = random.Random(seed)
    odd = [1.0, 2.0, math.nan, None, math.inf, -math.inf, -0.0, 0.0]
    return [(i, r.choice(["a", "b", "a\"", None]), 7.0 if i % 3 == 0 else r.choice(odd) if i % 3 == 1 else r.gauss(0, 1), i) for i in range(n)]


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_global_ranks(spark, keys):
    rows = ranked_rows()
    df = spark.createDataFrame(rows, "i long, k string, v double, rank long").repartition(7)
    want = pd.DataFrame(rows, columns=["i", "k", "v", "_"]).sort_values("i").dropna(subset=["v"])
    values = want.groupby(want.k.fillna("\0")).v if keys else want.v
    for ties in ("average", "min", "max", "dense", "ordinal"):
        out = O.ranked(df, "v", ties, *keys, order="i")
        assert sorted(out.columns) == sorted(df.columns)
        got = {r.i: r["rank"] for r in out.collect()}
        assert got == dict(zip(want.i, values.rank(method="first" if ties == "ordinal" else ties), strict=True)), ties
    assert O.ranked(df.where("false"), "v", "average", *keys).count() == 0


def test_ties_spread_over_ranges(spark):
    """More ranges than distinct values; a third of the rows share one value."""
    df = spark.createDataFrame([(i, float(i % 3 and i % 50)) for i in range(900)], "i long, v double").repartition(16)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = {r._x: (r.n, r.lowest, r.dense) for r in O.value_ranks(df, "v").collect()}
        ordinal = sorted((r.v, r.i, r["rank"]) for r in O.ranked(df, "v", "ordinal", order="i").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    values = sorted(float(i % 3 and i % 50) for i in range(900))
    kinds = sorted(set(values))
    assert runs == {v: (values.count(v), values.index(v) + 1, kinds.index(v) + 1) for v in kinds}
    assert [r for *_, r in ordinal] == [float(k) for k in range(1, 901)]


def test_scores_without_keys(spark):
    df = spark.createDataFrame([(i, float((i * 7) % 11)) for i in range(44)], "i long, v double").repartition(5)
    one = {r.i: r.score for r in X.normal_scores(df, "v").collect()}
    keyed = {r.i: r.score for r in X.normal_scores(df.selectExpr("i", "v", "1 AS k"), "v", "k").collect()}
    assert one == pytest.approx(keyed) and len(one) == 44


def long_rows(spark, y, start=0, step=1):
    return spark.createDataFrame([(start + i * step, j, float(v)) for i, row in enumerate(y) for j, v in enumerate(row)], "subject long, node long, value double").repartition(5)


def test_inference_on_tables_equals_the_matrix(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    d = G.Domain.from_volume((6, 5, 2), 6)
    x, c = rng.normal(size=14), rng.normal(size=(14, 2))
    y = rng.normal(size=(14, d.n)) + np.outer(x, np.r_[np.full(9, 1.5), np.zeros(d.n - 9)])
    df = long_rows(spark, y, 3, 4)
    base = P.tfce_ols(y, d, tested=x, confounds=c, seed=3, n_perm=40, spark=spark)
    settings = {"tested": x, "confounds": c, "seed": 3, "path": str(tmp_path / "null")}

    def result(out, null):
        a = out.orderBy("node").toPandas()
        return a.stat.tolist(), a.tfce.tolist(), a.p_fwe.tolist(), a.p_unc.tolist(), sorted(r["max"] for r in null.maxima().collect())

    want = (base.stat_obs.tolist(), base.tfce_obs.tolist(), base.p_fwe.tolist(), base.p_unc.tolist(), base.null.maxima.tolist())
    # 15 draws, then the 25 that are missing, with other block widths: the same bits as one run
    _, first = N.inference(df, d, n_perm=15, width=7, **settings)
    assert first.runs() == [(0, 15)]
    assert result(*N.inference(df, d, n_perm=40, width=60, **settings)) == want
    out, null = N.inference(df, d, n_perm=40, width=11, **settings)
    assert null.runs() == [(0, 15), (15, 40)] and result(out, null) == want
    with pytest.raises(InvalidParams):
        N.inference(df, d, n_perm=20, **settings)
    with pytest.raises(InvalidParams):
        N.inference(df, d, n_perm=50, **(settings | {"seed": 4}))
    with pytest.raises(InvalidParams):
        null.add(null.rows(), 41, 50)
    # a run that broke off before its line was written is run again
    null.rows().limit(1).write.parquet(f"{settings['path']}/draws_40_44")
    assert N.inference(df, d, n_perm=44, **settings)[1].draws == 44
    # data beyond the bound of one matrix
    monkeypatch.setattr(P, "LARGEST", 100)
    big = P.tfce_ols(df, d, tested=x, confounds=c, seed=3, n_perm=40)
    assert np.array_equal(big.null.maxima, base.null.maxima) and np.array_equal(big.p_fwe, base.p_fwe) and np.array_equal(big.null.exceed, base.null.exceed)
    with pytest.raises(InvalidParams):
        P.tfce_ols(df, d, tested=x, confounds=c, seed=3, n_perm=60, extend=base.null)


def test_enumerated_flips_and_single_precision(spark):
    rng = np.random.default_rng(8)
    d = G.Domain.from_volume((4, 4, 1), 6)
    y = (rng.normal(size=(6, 16)) + 0.8).astype(np.float32).astype(float)
    y[:, 5] = 0.0  # a node without variance
    base = P.tfce_ols(y, d, tail="positive", n_perm=100, spark=spark)
    out, null = N.inference(long_rows(spark, y), d, tail="positive", n_perm=100, width=5)
    a = out.orderBy("node").toPandas()
    assert null.draws == 64 and a.p_fwe.tolist() == base.p_fwe.tolist() and a.p_unc.tolist() == base.p_unc.tolist() and a.stat[5] == 0
    single = N.inference(long_rows(spark, y), d, tail="positive", n_perm=100, single=True)[0].orderBy("node").toPandas()
    np.testing.assert_allclose(single.stat, a.stat, rtol=1e-4, atol=1e-5)


def test_statistics_of_a_close_fit():
    """Values that hardly differ between subjects, against fractions: 1 less the square of the correlation would keep five digits or so."""
    y = 0.4 + 1e-6 * np.random.default_rng(4).normal(size=(8, 30))
    params = resolve_params({"weighting": "smith_nichols", "start": 0.5, "step": 0.5})
    design = P.Design(8, None, None, P.PermOpts(params, Tail.POSITIVE, 1, 256))
    for draw in (0, 37):
        got = P.t_values(design.rearranged(draw), design.residuals(y), design.dof)
        for t, column in zip(got, y.T, strict=True):
            v = [Fraction(x) * (1 - 2 * (draw >> i & 1)) for i, x in enumerate(column)]
            want = 7 * sum(v) ** 2 / (8 * sum(x * x for x in v) - sum(v) ** 2)
            assert abs(Fraction(t) ** 2 / want - 1) < 1e-8 and (t > 0) == (sum(v) > 0)
    lone = tfce_map(G.Domain.from_volume((1, 1, 1), 6), np.array([1500.25]), params, Tail.POSITIVE)
    assert math.isclose(lone[0], sum((0.5 + 0.5 * k) ** 2 * 0.5 for k in range(3000)), rel_tol=1e-12)  # every band below the statistic


def test_rows_that_no_block_takes(spark):
    d = G.Domain.from_volume((3, 2, 1), 6)
    y = np.arange(30.0).reshape(5, 6) ** 1.5
    good = long_rows(spark, y)
    for bad in (good.where("node <> 3"), good.where("NOT (node = 3 AND subject = 1)"), good.unionByName(good.where("node = 3 AND subject = 1")), good.unionByName(good.selectExpr("subject", "6 + node AS node", "value")), good.selectExpr("subject", "node", "CASE WHEN node = 2 THEN double('NaN') ELSE value END AS value")):
        with pytest.raises(Exception, match="needs one value|needs a value|finite"):
            N.inference(bad, d, n_perm=8)[0].count()
