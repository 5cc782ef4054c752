import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import bootstrap as B
from quillon.operators import order as O
from quillon.operators import resample as R
from quillon.operators import rng
from quillon.operators.errors import DomainError, TooFewObservations


def one_by_one(scheme, n, draw, seed):
    s = rng.Stream(seed, draw)
    if scheme is R.Scheme.BOOTSTRAP:
        return [s.bounded(n) for _ in range(n)]
    out = list(range(n))
    for i in range(n - 1, 0, -1):
        j = s.bounded(i + 1)
        out[i], out[j] = out[j], out[i]
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 1000, 40_000])
def test_vectorised_draws_are_those_of_the_stream(n):
    for scheme in R.Scheme:
        for draw in (0, 5):
            assert R.resample_indices(scheme, n, draw, 77).tolist() == one_by_one(scheme, n, draw, 77)


def test_rejected_words_move_the_later_bounds():
    """A bound near 2^32 / 2 rejects about half of the words: the first bounds of a long shuffle, against the stream."""
    n, s = 3_000_000_000, rng.Stream(9, 4)
    want = [s.bounded(n) for _ in range(500)]
    got = rng.bounded_words(9, 4, n, 0, 2000)
    assert s.at > 600 and got[:500].tolist() == want
    small = rng.falling_bounds(3, 1, 5000, block=7)
    s = rng.Stream(3, 1)
    assert small.tolist() == [s.bounded(b) for b in range(5000, 1, -1)]


def test_fill_after_single_words():
    a, b = rng.Stream(1, 2), rng.Stream(1, 2)
    first = [a.next_u32() for _ in range(3)] + a.fill_u32(200).tolist() + [a.next_u32()]
    assert first == b.fill_u32(204).tolist()


@pytest.mark.parametrize("n,block", [(1, 4), (10, 4), (1000, 64), (4096, 512), (777, 1 << 16)])
def test_blocks_give_the_same_draws(spark, n, block):
    got = {}
    for d, pos, row in B.drawn_rows(spark, n, 3, 77, block).collect():
        got.setdefault(d, {})[pos] = row
    for d in range(3):
        assert [got[d][p] for p in range(n)] == R.resample_indices(R.Scheme.BOOTSTRAP, n, d, 77).tolist()
        assert len(got[d]) == n


def test_offsets_where_words_are_rejected(spark):
    """With 3,000,000,000 rows 30 % of the words are rejected; the offsets are counts of those kept, held against a scan of the stream."""
    n, block = 3_000_000_000, 1000
    table = spark.createDataFrame([(d, k) for d in range(2) for k in range(5)], "_draw long, _block long")
    for d, k, kept in B._kept(table, n, 5, block).collect():
        w = rng.words(5, np.array([d], np.uint64), rng.STREAM_TAG_RESAMPLE, block, k * block)[0]
        assert kept == sum((int(x) * n) % 2**32 >= 2**32 % n for x in w) and 550 < kept < 850


def test_too_few_words_are_doubled(spark, monkeypatch):
    monkeypatch.setattr(B, "SPARE", -1e6)  # the first pass reads one block of eight words
    rows = B.drawn_rows(spark, 50, 2, 1, 8).orderBy("_draw", "_pos").collect()
    assert [r["_row"] for r in rows] == [x for d in range(2) for x in R.resample_indices(R.Scheme.BOOTSTRAP, 50, d, 1).tolist()]


def test_bootstrap_equals_the_broadcast_path(spark):
    df = spark.range(0, 300, 1, 7).select(F.col("id").alias("i"), ((F.col("id") * 37) % 101).cast("double").alias("x"))
    by_tables = {r.draw: r.m for r in B.bootstrap(df, ["i"], 20, 3, F.avg("x").alias("m"), block=64).collect()}
    by_tasks = {r.draw: r.stat for r in R.run_draws(df, "x", "i", R.Scheme.BOOTSTRAP, 20, 3, np.mean).collect()}
    assert by_tables.keys() == by_tasks.keys()
    assert max(abs(by_tables[d] - by_tasks[d]) for d in by_tasks) < 1e-9


def test_no_broadcast_of_the_base(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(0, 100).withColumn("x", F.col("id") * 1.0)
        plan = B.resampled(df, ["id"], 2, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan and "Window" not in plan  # offsets are stored before


def test_drawn_rows_are_not_broadcast(spark):
    """Spark's estimate of the drawn rows is the size of the table of blocks, far below the default threshold of broadcasts."""
    df = spark.range(0, 5000).withColumn("x", F.col("id") * 1.0)
    done = B.bootstrap(df, ["id"], 40, 1, F.count("*").alias("n"), F.countDistinct("id").alias("rows"), block=512)
    plan = done._jdf.queryExecution().executedPlan()
    assert {r.n for r in done.collect()} == {5000}
    for text in (plan.toString(), done._jdf.queryExecution().executedPlan().toString()):
        assert "Broadcast" not in text and "ShuffledHashJoin" in text


def test_distinct_rows_of_equal_columns(spark):
    """Rows that are equal, or null, are rows of their own."""
    df = spark.createDataFrame([(1, None), (1, None), (2, 5.0), (2, 5.0), (None, 7.0)], "k long, x double")
    got = {r.draw: (r.n, r.rows) for r in B.bootstrap(df, ["k", "x"], 6, 8, F.count("*").alias("n"), F.countDistinct("_row").alias("rows")).collect()}
    assert got == {d: (5, len(set(R.resample_indices(R.Scheme.BOOTSTRAP, 5, d, 8).tolist()))) for d in range(6)}


def test_defined_results(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 5.0, None), (None, 7.0, "c"), (2, 5.0, None)], "k long, x double, draw string")
    rows = B.resampled(df, ["k", "x"], 5, 8)
    assert rows.count() == 20 and set(rows.columns) == {"_draw", "_pos", "k", "x", "draw"}
    stat = B.bootstrap(df, ["k", "x"], 5, 8, F.count("*").alias("n"), F.max("draw").alias("most"))
    assert {r.n for r in stat.collect()} == {4} and stat.columns == ["draw", "n", "most"]
    with pytest.raises(TooFewObservations):
        B.bootstrap(df.where("k > 9"), ["k"], 2, 1, F.count("*").alias("n"))
    with pytest.raises(DomainError):
        B.resampled(df.withColumnRenamed("x", "_Row"), ["k"], 2, 1)


def test_numbered_is_the_order_of_its_columns(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, str(i % 3)) for i in range(1000)], "k long, t string").repartition(9)
    got = [(r.t, r.k) for r in sorted(O.numbered(df, "t", "k").collect(), key=lambda r: r.row)]
    assert got == sorted((r.t, r.k) for r in df.collect())
    assert sorted(r.row for r in O.numbered(df, "t", "k").collect()) == list(range(1000))
