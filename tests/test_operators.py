import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import accum as A
from quillon.operators import density as K
from quillon.operators import descriptive as D
from quillon.operators import graph as G
from quillon.operators import htest as H
from quillon.operators import permute as P
from quillon.operators import resample as R
from quillon.operators import tfce as T
from quillon.operators import transform as X
from quillon.operators.errors import DomainError, ProbabilityOutOfRange


def frame(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def test_missing_values_and_guards(spark):
    nan = math.nan
    r = frame(spark, [2.0, nan, None, 4.0, math.inf]).agg(D.count("x").alias("n"), D.maximum("x").alias("hi"), D.median("x").alias("m")).first()
    assert r.n == 3 and r.hi == math.inf and r.m == 4.0
    one = frame(spark, [3.0]).agg(D.var("x", D.Ddof.POPULATION).alias("v"), D.skewness("x").alias("g")).first()
    assert one.v is None and one.g is None
    same = frame(spark, [3.0, 3.0]).agg(D.skewness("x").alias("g"), D.pearson("x", "x").alias("r")).first()
    assert math.isnan(same.g) and math.isnan(same.r)
    r = frame(spark, [2.0, 4.0, 4.0, 4.0, 5.0, 5.0, 7.0, 9.0]).agg(D.skewness("x").alias("g1"), D.kurtosis("x").alias("g2"), D.quantile("x", [0.25, 0.75]).alias("q")).first()
    assert (r.g1, r.g2) == (pytest.approx(0.65625), pytest.approx(-0.21875)) and r.q == [4.0, 5.5]


def test_exact_sum(spark):
    df = spark.createDataFrame([("a", 1e16), ("a", 1.0), ("a", -1e16), ("b", 0.1), (None, 2.0)], "g string, x double").repartition(3)
    assert {r.g: r["sum"] for r in A.exact_sum(df, "x", "g").collect()} == {"a": 1.0, "b": 0.1, None: 2.0}
    assert A.exact_sum(df.where("false"), "x").count() == 0


def test_histogram_edges(spark):
    h = A.histogram(frame(spark, [0.0, 1.0, 9.99, 10.0, -1.0, 11.0, math.nan]), "x", 0.0, 10.0, 5).withColumn("e", A.ecdf("counts")).first()
    assert h.counts == [2, 0, 0, 0, 2] and (h.underflow, h.overflow) == (1, 1) and h.e == [0.5, 0.5, 0.5, 0.5, 1.0]
    with pytest.raises(DomainError):
        A.histogram(frame(spark, [1.0]), "x", 1.0, 1.0, 3)


def test_tdigest(spark):
    rng = np.random.default_rng(0)
    x = rng.exponential(size=20000)
    df = frame(spark, x.tolist()).repartition(7)
    d = A.tdigest(df, "x")
    qs = [0.001, 0.1, 0.5, 0.9, 0.999]
    got = d.select(*(A.tdigest_quantile("digest", q) for q in (0.0, *qs, 1.0)), A.tdigest_cdf("digest", 1.0)).first()
    assert got[0] == x.min() and got[6] == x.max()
    for q, v in zip(qs, got[1:6], strict=True):
        assert abs((x <= v).mean() - q) <= 0.0075
    assert abs(got[7] - (x <= 1).mean()) < 0.0075
    assert len(d.first().digest.means) < 250


def test_t_tests(spark):
    a, b = [5.1, 4.9, 6.2, 5.7, 5.5], [6.5, 6.1, 7.2, 5.9]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, x double")
    r = H.t_test_two(df, "x", "g", "a", "b", H.VarAssumption.WELCH).first()
    va, vb = np.var(a, ddof=1) / 5, np.var(b, ddof=1) / 4
    t = (np.mean(a) - np.mean(b)) / math.sqrt(va + vb)
    assert r.statistic == pytest.approx(t) and r.df == pytest.approx((va + vb) ** 2 / (va**2 / 4 + vb**2 / 3)) and r.ci_lower < np.mean(a) - np.mean(b) < r.ci_upper
    from quillon.functions.dist import StudentT

    assert r.p_value == pytest.approx(2 * float(StudentT(r.df).numpy.sf(abs(t))), rel=1e-10)
    few = H.t_test_one(df.where("x > 7"), "x", 0.0).first()
    assert few.statistic is None and few.status.startswith("needs 2")
    const = H.t_test_one(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x", 0.0).first()
    assert const.statistic == math.inf and const.p_value == 0
    with pytest.raises(ProbabilityOutOfRange):
        H.ci_mean(df, "x", 1.0)


def test_chi2_empty_cells(spark):
    t = spark.createDataFrame([("r", "c", 10), ("r", "d", 20), ("s", "d", 30)], "a string, b string, n int")
    r = H.chi2_independence(t, "a", "b").first()
    o = np.array([[10, 20], [0, 30]], float)
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert r.statistic == pytest.approx(((o - e) ** 2 / e).sum()) and r.df == 1


def test_anova_and_f(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 6.0), ("c", 7.0), ("c", 9.0)], "g string, x double")
    r = H.anova_one_way(df, "x", "g").first()
    assert r.statistic == pytest.approx((127 / 3 / 2) / (4.5 / 3)) and r.df == 2 and r.df2 == 3
    assert H.f_test_var(df, "x", "g", "a", "b").first().statistic == pytest.approx(0.25)


def test_ranks_and_scores(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, 3.0), (3, 2.0), (4, math.nan)], "i int, x double")
    want = {X.Ties.AVERAGE: [3.5, 1, 3.5, 2], X.Ties.MIN: [3, 1, 3, 2], X.Ties.MAX: [4, 1, 4, 2], X.Ties.DENSE: [3, 1, 3, 2], X.Ties.ORDINAL: [3, 1, 4, 2]}
    for ties, ranks in want.items():
        assert [r["rank"] for r in X.rank(df, "x", ties, order="i").orderBy("i").collect()] == ranks
    s = [r.score for r in X.normal_scores(df, "x").orderBy("i").collect()]
    assert s[0] == s[2] and s[1] == pytest.approx(-1.0491313979639705)


def test_power_transforms(spark):
    r = frame(spark, [4.0]).select(X.box_cox("x", 0.5), X.box_cox("x", 0.0), X.yeo_johnson("x", 0.0), X.yeo_johnson(-F.col("x"), 2.0)).first()
    assert list(r) == pytest.approx([2.0, math.log(4), math.log(5), -math.log(5)])
    with pytest.raises(Exception, match="positive"):
        frame(spark, [-1.0]).select(X.box_cox("x", 1.0)).collect()


def test_quantile_normalize(spark):
    m = np.array([[5.0, 2, 3, 4], [4, 1, 4, 2], [3, 4, 6, 8]])
    df = spark.createDataFrame([(c, r, float(m[c, r])) for c in range(3) for r in range(4)], "c int, r int, v double")
    got = {(r.c, r.r): r.v for r in X.quantile_normalize(df, "c", "r", "v").collect()}
    t = np.sort(m, 1).mean(0)
    assert got[0, 0] == pytest.approx(t[3]) and got[0, 1] == pytest.approx(t[0])
    assert got[1, 0] == got[1, 2] == pytest.approx((t[2] + t[3]) / 2)
    holes = df.withColumn("v", F.when((F.col("c") == 1) & (F.col("r") == 3), None).otherwise(F.col("v")))
    back = {(r.c, r.r): r.v for r in X.quantile_normalize(holes, "c", "r", "v").collect()}
    assert back[1, 3] is None and sum(v is not None for v in back.values()) == 11


def normalised(m, extremes=False):
    """Quantile normalisation of columns [col, row], written from its definition: places, means of finite contributions, pooled to rise, mid-ranks."""
    n = m.shape[1]
    seen = ~np.isnan(m) if extremes else np.isfinite(m)
    contributions = [[] for _ in range(n)]
    for c in range(len(m)):
        v = np.sort(m[c, seen[c]])
        for i in range(n if len(v) else 0):
            t = (len(v) - 1) * i / (n - 1)
            lo, hi = int(math.floor(t)), int(math.ceil(t))
            x = v[lo] if lo == hi else v[lo] + (v[hi] - v[lo]) * (t - lo)
            if math.isfinite(x):
                contributions[i].append(x)
    have = [i for i in range(n) if contributions[i]]
    pools = []
    for i in have:
        pools.append([sum(contributions[i]), len(contributions[i]), 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            top = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], top, strict=True)]
    target = np.interp(range(n), have, [p[0] / p[1] for p in pools for _ in range(p[2])])
    out = m.copy()
    for c in range(len(m)):
        rows = np.flatnonzero(seen[c])
        for r in rows[np.isfinite(m[c, rows])]:
            k = (m[c, rows] < m[c, r]).sum() + ((m[c, rows] == m[c, r]).sum() - 1) / 2
            out[c, r] = np.interp((n - 1) / 2 if len(rows) == 1 else (n - 1) * k / (len(rows) - 1), range(n), target)
    return out


def test_quantile_normalize_with_missing_entries(spark):
    """One value in a column counts at every place; infinities as extremes stay where they are; pooled targets."""
    nan, inf = math.nan, math.inf
    cases = [
        (np.array([[1.0, 7, 3, 5], [nan, 4, nan, nan], [2, nan, 8, 6]]), False), (np.array([[nan, 2.0, nan], [nan, nan, nan], [3.0, nan, 1.0]]), False),
        (np.array([[2.0, -inf, 3], [0, 5, 7]]), True), (np.array([[inf, -inf, 3, 9], [0, 5, 7, nan], [inf, inf, 1, 2]]), True), (np.array([[inf, -inf, 3, 9], [0, 5, 7, nan]]), False),
    ]
    for m, extremes in cases:
        df = spark.createDataFrame([(c, r, float(m[c, r])) for c in range(m.shape[0]) for r in range(m.shape[1])], "c int, r int, v double")
        got = np.full(m.shape, nan)
        for x in X.quantile_normalize(df, "c", "r", "v", X.Infinities.AS_EXTREMES if extremes else X.Infinities.AS_MISSING).collect():
            got[x.c, x.r] = nan if x.v is None else x.v
        np.testing.assert_allclose(got, normalised(m, extremes), rtol=1e-12)
    np.testing.assert_array_equal(normalised(cases[2][0], True), [[3.5, -inf, 5.0], [0.0, 3.5, 5.0]])


def test_f_test_of_constant_samples(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    r = H.f_test_var(df, "x", "g", "a", "b").first()
    assert math.isnan(r.statistic) and math.isnan(r.p_value)


def test_settings():
    fsl = T.resolve_params({"weighting": "fslmaths", "start": 0.2, "step": 0.3})
    h, w = T.grid(fsl, 1.0)
    np.testing.assert_allclose(w, h**2)
    assert T.resolve_params({"weighting": "exact", "h": 1}).start == 0 and T.resolve_params("nilearn").weighting is T.Weighting.NILEARN
    wrong = ["mne", {"e": 1}, {"weighting": "exact", "step": 1}, {"weighting": "nilearn", "start": 0}, {"weighting": "mne", "start": 0.1}, {"weighting": "smith_nichols", "start": -1, "step": 1}]
    wrong += [{"weighting": "mne", "start": 0, "step": 0}, {"weighting": "exact", "h": -1}, {"weighting": "exact", "e": "x"}, {"weighting": "exact", "e": math.inf}, {"weighting": "other"}, 3]
    for p in wrong:
        with pytest.raises(T.InvalidParams):
            T.resolve_params(p)
    with pytest.raises(T.InvalidParams):
        P.tfce_ols(np.zeros((4, 1)), G.Domain.from_volume((1, 1, 1), 6), params={"weighting": "fslmaths", "start": 0.1, "step": 0.1})


def test_transform_queries_cover_all_rows(spark, tmp_path):
    """Against brute force: missing entries and all columns, the tails of events, and digamma(1)."""
    from quillon.plans import transforms

    r = np.random.default_rng(8)
    m = np.round(r.gamma(2.0, 900.0, (7, 9)), 2)
    m[4, :2] = m[5, 3:6] = m[6, [1, 8]] = np.nan
    rows = [(int(c) + 1, int(s), float(m[c, s]), float(q)) for q, (c, s) in enumerate(zip(*np.nonzero(~np.isnan(m)), strict=True), 1)]
    spark.createDataFrame(rows, "l_linenumber int, l_suppkey long, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(x.c, x.r): x.v for x in transforms.quantile_normalize(spark, str(tmp_path)).collect()}
    n, seen = m.shape[1], [np.flatnonzero(~np.isnan(c)) for c in m]
    place = [np.arange(len(s)) * (n - 1) / (len(s) - 1) for s in seen]
    target = np.mean([np.interp(np.arange(n), p, np.sort(c[s])) for c, s, p in zip(m, seen, place, strict=True)], 0)
    want = {(c + 1, int(s)): float(np.interp(place[c][k], np.arange(n), target)) for c in range(7) for k, s in enumerate(seen[c][np.argsort(m[c, seen[c]])])}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=6e-4) for k in want)
    values = [-200.0, 0.0, 50.0, 169.0, 171.0, 300.0, 490.02, 560.21]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = {x.event_id: x for x in transforms.pit_and_map(spark, str(tmp_path)).collect()}
    for i, v in enumerate(values):
        upper = math.erfc((v - 50) / 30 / math.sqrt(2)) / 2
        assert found[i].u == pytest.approx(1 - upper, abs=1e-8) and found[i].mapped == pytest.approx(-math.log(upper), abs=1e-5)
    back = {x.q: x.digamma for x in transforms.digamma(spark, str(tmp_path)).collect()}
    assert len(back) == len(rows) and all(back[q] == pytest.approx(-0.5772156649015329 + sum(1 / j for j in range(1, int(q))), abs=2e-9) for q in back)


def test_density(spark):
    x = [1.0, 2.0, 4.0]
    fit = K.kde(frame(spark, x), "x", K.Kernel.EPANECHNIKOV, K.Bandwidth("fixed", 1.5))
    got = {r.x: r.density for r in fit.evaluate(frame(spark, [0.0, 2.0, 99.0, math.inf]), "x").collect()}
    u = (2.0 - np.array(x)) / 1.5
    assert got[2.0] == pytest.approx((0.75 * (1 - u**2) * (abs(u) <= 1)).sum() / 4.5) and got[99.0] == 0 and got[math.inf] == 0
    with pytest.raises(DomainError):
        K.kde(frame(spark, [1.0, 1.0]), "x", K.Kernel.GAUSSIAN, K.SCOTT)
    with pytest.raises(DomainError):
        K.histogram_auto(frame(spark, [1.0, 1.0]), "x", K.Bins(count=3), K.Norm.COUNT)


def test_streams_of_known_draws():
    assert R.resample_indices(R.Scheme.PERMUTATION, 10, 5, 77).tolist() == [2, 4, 5, 9, 3, 8, 7, 0, 1, 6]
    assert R.resample_indices(R.Scheme.BOOTSTRAP, 10, 5, 77).tolist() == [6, 1, 1, 0, 1, 6, 2, 6, 3, 5]
    assert R.sign_flips(12, 5, 77).tolist() == [1, -1, 1, 1, -1, -1, -1, 1, 1, 1, -1, -1]


def test_draws_do_not_depend_on_the_split(spark):
    df = frame(spark, [float(i * i % 17) for i in range(30)]).withColumn("i", F.monotonically_increasing_id())
    one, four = (sorted(map(tuple, R.run_draws(df, "x", "i", R.Scheme.BOOTSTRAP, 40, 3, np.mean, p).collect())) for p in (1, 4))
    assert one == four
    p = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "stat double").agg(R.null_p("stat", 2.5, R.Sidedness.GREATER)).first()[0]
    assert p == pytest.approx(0.5)


def naive(domain, stat, thresholds, weights, e, strict=True):
    out = np.zeros(len(stat))
    off, near = domain.to_csr()
    for h, w in zip(thresholds, weights, strict=True):
        inside = stat > h if strict else stat >= h
        seen = np.zeros(len(stat), bool)
        for s in np.flatnonzero(inside):
            if seen[s]:
                continue
            comp, todo = [], [s]
            seen[s] = True
            while todo:
                i = todo.pop()
                comp.append(i)
                for j in near[off[i] : off[i + 1]]:
                    if inside[j] and not seen[j]:
                        seen[j] = True
                        todo.append(j)
            out[comp] += len(comp) ** e * w
    return out


@pytest.mark.parametrize("conn", [6, 18, 26])
def test_enhancement_against_reclustering(conn):
    rng = np.random.default_rng(conn)
    d = G.Domain.from_mask(rng.random((5, 4, 6)) < 0.8, conn)
    for ties in (False, True):
        s = rng.normal(size=d.n)
        s = np.round(s * 2) / 2 if ties else s
        for w in (T.Weighting.SMITH_NICHOLS, T.Weighting.MNE_STEP, T.Weighting.NILEARN, T.Weighting.FSLMATHS):
            p = T.TfceParams(w, start=0.1, step=0.3)
            h, g = T.grid(p, float(s.max()))
            want = naive(d, s, h, g, 0.5, w is not T.Weighting.NILEARN)
            np.testing.assert_allclose(T.tfce_map(d, s, p), want, rtol=1e-12, atol=1e-12)
        fine = T.tfce_map(d, s, T.TfceParams(T.Weighting.SMITH_NICHOLS, start=0.0005, step=0.001))
        np.testing.assert_allclose(T.tfce_map(d, s, T.PRESETS["exact"]), fine, rtol=2e-2, atol=2e-2)
    two = T.tfce_map(d, s, T.PRESETS["exact"], T.Tail.TWO_SIDED)
    np.testing.assert_allclose(two, T.tfce_map(d, s, T.PRESETS["exact"]) - T.tfce_map(d, -s, T.PRESETS["exact"]))


def test_domains(spark):
    d = G.Domain.from_volume((3, 4, 2), 18)
    nodes = G.node_table(spark, (3, 4, 2))
    edges = sorted(map(tuple, G.edge_table(nodes, (3, 4, 2), 18).collect()))
    off, near = d.to_csr()
    assert edges == sorted((i, int(j)) for i in range(d.n) for j in near[off[i] : off[i + 1]])
    again = G.Domain.from_csr(off, near)
    assert again.n_edges == d.n_edges
    assert G.Domain.from_adjacency([0, 1, 1, 2], [1, 0, 1, 0], [1, 1, 1, 0]).n_edges == 2
    with pytest.raises(G.NeuroError):
        G.Domain.from_csr([0, 1], [0])


def test_bands_by_joins(spark):
    rng = np.random.default_rng(3)
    d = G.Domain.from_volume((4, 3, 3), 6)
    s = rng.normal(size=d.n)
    maps = spark.createDataFrame([(7, i, float(v)) for i, v in enumerate(s)], "map_id long, node long, stat double")
    edges = G.edge_table(G.node_table(spark, (4, 3, 3)), (4, 3, 3), 6)
    got = {r.node: r.tfce for r in T.tfce_naive(maps, edges, [0.0, 0.5, 1.0], [1.0, 2.0, 0.5], 0.5).collect()}
    want = T.bands(d, s, np.array([0.0, 0.5, 1.0]), np.array([1.0, 2.0, 0.5]), 0.5)
    np.testing.assert_allclose([got[i] for i in range(d.n)], want)
    with pytest.raises(T.InvalidBands):
        T.tfce_bands(maps, d, [1.0, 0.5], [1.0, 1.0], 0.5)


def test_labels_that_do_not_settle(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    chain = spark.createDataFrame([(7, i, 1.0) for i in range(30)], "map_id long, node long, stat double")
    edges = spark.createDataFrame([x for i in range(29) for x in ((i, i + 1), (i + 1, i))], "src long, dst long")
    with pytest.raises(RuntimeError, match="settle"):
        T.tfce_naive(chain, edges, [0.5], [1.0], 1.0, most=2)


def test_inference(spark, tmp_path):
    rng = np.random.default_rng(5)
    d = G.Domain.from_volume((4, 4, 1), 6)
    x, c = rng.normal(size=14), rng.normal(size=(14, 2))
    y = rng.normal(size=(14, 16)) + np.outer(x, np.r_[np.full(4, 2.0), np.zeros(12)]) + c @ rng.normal(size=(2, 16))
    base = P.tfce_ols(y, d, tested=x, confounds=c, seed=3, n_perm=60, num_partitions=3, spark=spark)
    # the observed t is that of a refit
    z = np.column_stack((np.ones(14), x, c))
    b, *_ = np.linalg.lstsq(z, y, rcond=None)
    rss = ((y - z @ b) ** 2).sum(0) / (14 - 4)
    np.testing.assert_allclose(base.stat_obs, b[1] / np.sqrt(rss * np.linalg.inv(z.T @ z)[1, 1]), rtol=1e-9)
    alone = P.tfce_ols(y, d, tested=x, confounds=c, seed=3, n_perm=60, num_partitions=1, spark=spark)
    assert np.array_equal(base.null.maxima, alone.null.maxima) and np.array_equal(base.p_fwe, alone.p_fwe)
    first = P.tfce_ols(y, d, tested=x, confounds=c, seed=3, n_perm=25, spark=spark)
    path = str(tmp_path / "null")
    first.save(spark, path)
    more = P.tfce_ols(y, d, tested=x, confounds=c, seed=3, n_perm=60, extend=P.TfceInference.load(spark, path).null, spark=spark)
    assert np.array_equal(more.null.maxima, base.null.maxima) and np.array_equal(more.p_unc, base.p_unc)
    assert base.p_fwe[:4].max() < 0.1
    exact = P.tfce_ols(y[:6], d, seed=1, n_perm=64, spark=spark)
    assert len(exact.null.maxima) == 64 and exact.p_unc.min() >= 1 / 64
    with pytest.raises(P.DegenerateDesign):
        P.tfce_ols(y, d, tested=np.ones(14), spark=spark)
    with pytest.raises(P.InvalidParams):
        P.tfce_ols(y, d, tested=x, confounds=c, seed=4, n_perm=60, extend=first.null, spark=spark)


def test_entry_contract(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and e.entry(spark).count() > 0
