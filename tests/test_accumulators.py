"""The contract of accumulators, their states as columns, and digests of streams."""

import datetime
import fractions
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import accum as A
from quillon.operators.errors import DomainError
from quillon.plans import streams

VALUES = [random.Random(3).gauss(10, 4) * 10 ** random.Random(k).randint(-6, 9) for k in range(4000)]
ALL = [A.Sum(), A.Moments(), A.Histogram(-50.0, 50.0, 13), A.Digest()]


def fed(acc, parts):
    done = acc.init()
    for p in parts:
        done = acc.merge(done, acc.update(acc.init(), np.array(p, float)))
    return done


@pytest.mark.parametrize("acc", ALL, ids=lambda a: type(a).__name__)
def test_contract(acc):
    x = VALUES[:500]
    empty = acc.init()
    whole = acc.update(empty, np.array(x))
    assert acc.finish(acc.merge(whole, empty)) == acc.finish(acc.merge(empty, whole)) == acc.finish(acc.update(whole, np.array([])))
    assert len(empty) == len(acc.state.split(", ")) and len(acc.finish(whole)) == len(acc.result.split(", "))
    if not isinstance(acc, A.Digest):
        for cut in (1, 7, 499):
            a, b = fed(acc, [x[:cut], x[cut:]]), whole
            for p, q in zip(acc.finish(a), acc.finish(b), strict=True):
                assert p == pytest.approx(q, rel=1e-9)


def test_sums_are_exact_under_any_split():
    r = random.Random(9)
    x = [r.choice([1, -1]) * r.random() * 10.0 ** r.randint(-300, 300) for _ in range(600)]
    exact = float(sum(map(fractions.Fraction, x)))
    for _ in range(20):
        r.shuffle(x)
        cuts = sorted(r.sample(range(600), r.randint(0, 9)))
        assert A.Sum().finish(fed(A.Sum(), [x[a:b] for a, b in zip([0, *cuts], [*cuts, 600], strict=True)])) == (600, exact)
    for odd, want in (([1.0, math.inf], math.inf), ([math.inf, -math.inf], math.nan), ([1e308, 1e308], math.inf), ([], 0.0)):
        got = A.Sum().finish(fed(A.Sum(), [[v] for v in odd]))[1]
        assert got == want or math.isnan(got) and math.isnan(want)


def test_moments_far_from_zero():
    x = 1e9 + np.random.default_rng(2).normal(size=2000)
    n, mean, var, g1, g2 = A.Moments().finish(fed(A.Moments(), np.array_split(x, 17)))
    d = x - 1e9
    assert n == 2000 and mean == pytest.approx(1e9 + d.mean(), rel=1e-15)
    assert var == pytest.approx(d.var(ddof=1), rel=1e-9)
    z = (d - d.mean()) / d.std()
    assert g1 == pytest.approx((z**3).mean(), abs=1e-6) and g2 == pytest.approx((z**4).mean() - 3, abs=1e-6)
    assert A.Moments().finish(A.Moments().init())[2:] == (None, None, None)
    assert math.isnan(A.Moments().finish(fed(A.Moments(), [[2.0] * 5]))[3])


def test_one_state_for_each_task_and_group(spark):
    df = spark.createDataFrame([(f"g{i % 3}", float(i)) for i in range(9000)], "key string, x double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        parts = A._task_states(df, A.Digest()).collect()
        one = {r.key: r.n for r in A._merged(A._task_states(df, A.Digest()), A.Digest()).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(parts) == 15 and one == {"g0": 3000, "g1": 3000, "g2": 3000}


def test_many_groups_are_given_out(spark, monkeypatch):
    monkeypatch.setattr(A, "MOST_GROUPS", 20)
    df = spark.createDataFrame([(i % 300, float(i)) for i in range(3000)], "k int, x double")
    got = A.finish(A.accumulate(df, A.Moments(), "x", "k"), A.Moments()).collect()
    assert len(got) == 300 and all(r.n == 10 and r["mean"] == r.k + 1350 for r in got)


@pytest.mark.parametrize("acc", ALL, ids=lambda a: type(a).__name__)
def test_states_are_columns_and_roll_up(spark, tmp_path, acc):
    rows = [(random.Random(i).choice(["a", None, "b"]), i % 4, v) for i, v in enumerate(VALUES)] + [("c", 0, None), ("a", 1, math.nan)]
    df = spark.createDataFrame(rows, "g string, h int, x double").repartition(6)
    fine = A.accumulate(df, acc, "x", "g", "h")
    fine.write.parquet(str(tmp_path / "states"))
    kept = spark.read.parquet(str(tmp_path / "states"))
    up = {r.g: r for r in A.finish(A.roll_up(kept, acc, "g"), acc).collect()}
    direct = {r.g: r for r in A.finish(A.accumulate(df, acc, "x", "g"), acc).collect()}
    assert set(up) == set(direct) == {"a", None, "b"} and kept.count() == 12
    for g, r in direct.items():
        if isinstance(acc, A.Digest):
            x = np.sort([v for k, _, v in rows if k == g and v is not None and not math.isnan(v)])
            assert (up[g].n, up[g].least, up[g].most) == (len(x), x[0], x[-1]) and sum(up[g].weights) == len(x) and len(up[g].means) < 110
        else:
            for p, q in zip(tuple(up[g])[1:], tuple(r)[1:], strict=True):
                assert p == (q if isinstance(acc, A.Sum) else pytest.approx(q, rel=1e-6))
    total = A.finish(A.roll_up(kept, acc), acc).collect()
    assert len(total) == 1 and A.accumulate(df.where("false"), acc, "x", "g").count() == 0


def test_settings():
    for bad in (lambda: A.Histogram(1.0, 1.0, 3), lambda: A.Histogram(0.0, math.inf, 3), lambda: A.Histogram(0.0, 1.0, 0), lambda: A.Digest(0.5)):
        with pytest.raises(DomainError):
            bad()


def test_stream_of_digests_leaves_late_rows_out(spark, tmp_path):
    start = 1_700_006_400  # midnight, UTC
    rows = [(i, start + i * 900, "a" if i % 4 else "b", float(i % 97)) for i in range(2000)] + [(5000, start + 50, "a", None)]
    df = spark.createDataFrame(rows, "event_id long, s long, event_type string, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "event_type", "value")
    df.write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.event_type, r.start): r for r in streams.stream_digests(spark, str(tmp_path)).collect()}
    last = start + 1999 * 900
    third = (last - start) / 3
    want = {}
    for i, s, kind, v in rows:
        day = s - s % 86400
        if v is not None and day + 86400 <= last - 2 * 86400 and not (s - start < third and i % 10 == 0):
            want.setdefault((kind, day), []).append(v)
    assert {(k, int(d.timestamp()) if d.tzinfo else int((d - datetime.datetime(1970, 1, 1)).total_seconds())): (r.n, r.lo, r.hi, r.within) for (k, d), r in got.items()} == {k: (len(v), min(v), max(v), True) for k, v in want.items()}
    assert sum(map(len, want.values())) < sum(v is not None and s - s % 86400 + 86400 <= last - 2 * 86400 for _, s, _, v in rows) - 40
