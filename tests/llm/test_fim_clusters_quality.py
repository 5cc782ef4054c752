"""Fill-in-the-middle, centroid clustering and the quality classifier against brute-force versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import cluster, fim, op11, op12, op13, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word one\nand two " * 30_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def written(spark, path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 12 fill-in-the-middle --------------------------------------------------------------------------------------------


def brute_fim(doc_id, text):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = sha(f"7:{'null' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return len(u), "plain", None, None, sha(t), sha(t)
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return len(u), form, len(p), len(m), sha(out), sha(t)


def test_op12_against_brute_force(spark, tmp_path):
    r = random.Random(1)
    texts = [None, "", "\n", "\n\n", "a", "a\n", "a\nb", "x <P> y\nz", "<S>", "<M>\n", "<P", "é\n🙂\r\n\x00\x85 z\n", LONG, LONG, "<P" * 9000 + "\n"]
    texts += ["".join(r.choice("ab\n🙂<PSM>") for _ in range(r.randint(0, 60))) for _ in range(300)]
    rows = [*enumerate(texts), (7, "same\nid"), (7, "same\nid"), (None, "no\nid"), (-5, "below\nzero\n")]
    got = op12.op12_fill_in_middle(spark, written(spark, tmp_path, documents=docs(spark, rows).repartition(3))).collect()
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *brute_fim(i, t)) for i, t in rows), key=key)


def test_ropes():
    r = random.Random(2)
    text = "".join(r.choice("ab\n🙂") for _ in range(50_000))
    tree = fim.rope(text)
    assert fim.written(tree) == text and tree.depth <= 5
    for _ in range(200):
        at = r.randint(-3, len(text) + 3)
        a, b = fim.split(tree, at)
        cut = min(max(at, 0), len(text))
        assert fim.written(a) == text[:cut] and fim.written(b) == text[cut:]
        assert a.ends == text[:cut].count("\n") and a.chars == cut
        assert fim.written(fim.join(b, a)) == text[cut:] + text[:cut] and fim.join(b, a).depth <= 12
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert fim.units(tree) == len(lines)
    for k in (0, 1, 77, len(lines) - 1, len(lines), len(lines) + 5):
        assert fim.rank(tree, k) == len("".join(lines[:k]))


def test_fim_rates_names_and_empty_tables(spark):
    df = docs(spark, [(i, f"a{i}\nb\nc\n") for i in range(400)]).withColumn("output", F.lit("kept")).withColumnRenamed("text", "form")
    out = fim.transform(df, text="form", keep=("doc_id", "output", "form"), rate=40, spm=0)
    assert out.columns[:3] == ["doc_id", "output", "form"]
    forms = out.toDF("doc_id", "kept", "text", "n", "form", "p", "m", "out").withColumn("back", fim.restored("out", "form"))
    n = {r.form: r["count"] for r in forms.groupBy("form").count().collect()}
    assert set(n) == {"plain", "psm"} and 110 < n["psm"] < 210
    assert forms.where("back <> text").count() == 0 and forms.where("kept <> 'kept'").count() == 0
    assert fim.transform(df.where("false"), text="form").count() == 0
    with pytest.raises(ValueError):
        fim.transform(df, text="form", rate=101)
    with pytest.raises(ValueError):
        fim.restore("<S>a<P>b", "spm")


# --- 11 clusters ------------------------------------------------------------------------------------------------------


def brute_clusters(vectors, k, rounds, seed=3):
    """Python integers all the way: (id, cluster, distance) and centroids."""
    first = sorted(vectors, key=lambda v: (v[0] is None, sha(f"{seed}:{v[0]}"), v[1]))[:k]
    c = [list(v) for _, v in first]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    assign = lambda: [min(range(len(c)), key=lambda j: (dist(v, c[j]), j)) for _, v in vectors]
    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(vectors, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, o, dist(v, c[o])) for (i, v), o in zip(vectors, assign(), strict=True)], c


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, values array<long>")


@pytest.mark.parametrize("scale", [2, 40, 10**6, 2**40])
def test_clusters_against_integers(spark, scale):
    r = random.Random(scale)
    rows = [(i % 110, [r.randint(-scale, scale) for _ in range(5)]) for i in range(160)] + [(None, [1] * 5), (500, [3] * 5), (501, [3] * 5)]
    rows += [(600 + i, [7] * 5) for i in range(80)]  # copies
    got, c = cluster.clusters(vectors_of(spark, rows).repartition(5), 7, 6)
    want, wanted = brute_clusters(rows, 7, 6)
    assert [list(map(int, x)) for x in c] == wanted
    fits = [(i, o, d if d < 2**63 else None) for i, o, d in want]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(fits, key=str)


def test_screening_intervals_hold():
    r = np.random.default_rng(4)
    screened = 0
    for scale in (1, 3, 2**12, 2**26):
        x, c = r.integers(-scale, scale + 1, (400, 64)), r.integers(-scale, scale + 1, (9, 64))
        c[5] = c[2]  # a tie everywhere
        c[8] = x[0]
        x[:50] = c[2] + r.integers(-1, 2, (50, 64))
        low, high = cluster.intervals(x, c)
        exact = np.array([[sum(int(b) ** 2 for b in cc) - 2 * sum(int(a) * int(b) for a, b in zip(xx, cc, strict=True)) for cc in c] for xx in x], object)
        assert (low <= exact).all() and (exact <= high).all()
        d = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(xx, cc, strict=True)) for cc in c] for xx in x], object)
        found, again = cluster.nearest(x, c)
        assert found.tolist() == [min(range(9), key=lambda j, q=q: (q[j], j)) for q in d]
        assert not (found == 5).any() and again >= 2 * (found == 2).sum()
        screened += x.shape[0] * 9 - again
    assert screened > 4 * 400 * 9 * 0.6  # most pairs need no integers
    huge = np.array([[2**62, -(2**62)], [0, 0]], np.int64)
    assert cluster.nearest(huge, huge[::-1].copy())[0].tolist() == [1, 0]


def test_op11_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    r = random.Random(3)
    v = lambda: [r.uniform(-2, 2) for _ in range(64)]
    rows = [(i, v(), 0) for i in range(30)] + [(3, v(), 0), (40, None, 0), (41, [], 0), (42, [1.0] * 63, 0), (43, [1.0] * 65, 0), (44, [*v()[:63], None], 0), (45, [nan, *v()[:63]], 0), (46, [*v()[:63], -inf], 0), (None, v(), 0)]
    kind = "vec_id long, embedding array<float>, cluster int"
    df = spark.createDataFrame(rows, kind)
    got = op11.op11_centroids(spark, written(spark, tmp_path / "a", embeddings=df)).collect()
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in e]) for i, e, _ in rows if e and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    want, c = brute_clusters(kept, 8, 10)
    inertia = [sum(d for _, o, d in want if o == j) for j in range(8)]
    full = [(i, o, d, inertia[o], sum(inertia), sha(",".join(map(str, c[o])))) for i, o, d in want]
    assert sorted(map(tuple, got), key=str) == sorted(full, key=str) and len(got) == 32
    few = op11.op11_centroids(spark, written(spark, tmp_path / "b", embeddings=df.where("vec_id < 3"))).collect()
    assert sorted(x.cluster for x in few) == [0, 1, 2] and {x.inertia for x in few} == {0}
    assert op11.op11_centroids(spark, written(spark, tmp_path / "c", embeddings=df.where("false"))).count() == 0


# --- 13 quality -------------------------------------------------------------------------------------------------------


def test_context_vectors_against_a_plain_count(spark):
    places, signs = quality.index_vectors()
    vector = lambda w: dict(zip(places[w].tolist(), signs[w].tolist(), strict=True))
    texts = ["The cat sat, the cat sat!! 12", "", None, "cat CAT cat ...", "é " * 30]
    reader = quality.Reader()
    rows = [reader.ids(t) for t in texts]
    want = np.zeros((quality.VOCABULARY, quality.WIDTH))
    for r in rows:
        for i, w in enumerate(r.tolist()):
            for away in (-2, -1, 1, 2):
                if 0 <= i + away < len(r):
                    for p, s in vector(int(r[i + away])).items():
                        want[w, (p + quality.SHIFT * away) % quality.WIDTH] += s
    assert np.array_equal(quality.contexts(rows, places, signs), want)
    df = docs(spark, list(enumerate(texts)))
    ids = np.concatenate(rows)
    words, n = np.unique(ids, return_counts=True)
    expected = quality.finished(words, n, want[words])
    for parts in (1, 4):
        assert np.allclose(quality.word_vectors(df.repartition(parts)), expected, atol=1e-6)
    x = expected[rows[0]].astype(float)
    assert np.allclose(quality.pooled(rows[0], expected), [*x.mean(0), *x.std(0), np.log1p(len(x)) / 10], atol=1e-6)


def test_words_and_shapes():
    r = quality.Reader()
    named = {int(quality._SHAPE_ROWS[i]): s[1:] for i, s in enumerate(quality.SHAPES)}
    shapes = lambda t: [named[int(x)] for x in r.ids(t)[1::2]]
    assert shapes("the Cat DOG A eX 12 a1 !! !? . ___") == ["lower", "title", "upper", "title", "mixed", "digit", "mixed", "signs", "sign", "sign", "signs"]
    assert shapes("on on On on\non") == ["lower", "same", "same", "same", "same"]
    assert len(r.ids(None)) == 0 and len(r.ids(" \n")) == 0
    assert r.ids("One one")[0] == r.ids("ONE")[0]


def test_network_gradient_and_temperature():
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 4))
    p = 1 / (1 + np.exp(-2 * (x[:, 0] + x[:, 1] * x[:, 2])))  # not linear
    y = (r.random(3000) < p).astype(float)
    net = quality.Network(4)
    net.train(x[:2000], y[:2000], np.ones(2000), rounds=600)
    hot = net.logits(x[2000:])
    net.w[2], net.w[3] = net.w[2] * 5, net.w[3] * 5  # five times too sure
    net.calibrate(x[2000:], y[2000:], np.ones(1000))
    assert 3.5 < net.temperature < 9
    got = net.probability(x[2000:])
    assert ((got > 0.5) == (p[2000:] > 0.5)).mean() > 0.85
    for lo in (0.1, 0.4, 0.7):
        band = (got > lo) & (got < lo + 0.25)
        assert abs(got[band].mean() - y[2000:][band].mean()) < 0.09
    assert np.isfinite(hot).all()


def junk(r, words):
    kind = r.randrange(3)
    return " | ".join(words) if kind == 0 else " ".join(w.upper() + "!!" for w in words) if kind == 1 else " ".join(w for w in words[:9] for _ in range(12))


def test_op13_held_out_accuracy(spark, tmp_path):
    r = random.Random(7)
    word = lambda: "".join(r.choice(["an", "er", "st", "o", "the", "li", "qu"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(700):
        bad = i % 6 == 0
        words = [word() for _ in range(r.randint(20, 90))]
        rows.append((i, junk(r, words) if bad else ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, len(words), 9)) + "."))
        labels += [(i, int(not bad), 0)] if i % 4 else []
    rows += [(700, None), (701, ""), (702, LONG), (None, "No id at all."), (5, rows[5][1]), (5, rows[5][1])]
    labels += [(5, None, 0), (None, 0, 0), (9, 1, 0), (9, 1, 1)]
    sf = written(spark, tmp_path, documents=docs(spark, rows).repartition(4), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = op13.op13_quality(spark, sf).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 700]
    right = [x.predicted == int(x.doc_id % 6 != 0) for x in held]
    assert len(held) > 100 and sum(right) / len(right) > 0.97
    by = {x.doc_id: x for x in got}
    assert by[700].score == by[701].score and by[None].held_out
    again = {x.doc_id: x.score for x in op13.op13_quality(spark, sf).collect()}
    assert all(abs(again[k] - x.score) < 1e-9 for k, x in by.items())


def test_quality_labels_do_not_leak_and_odd_tables(spark):
    df = docs(spark, [(i, f"text number {i} . ." * (1 + i % 3)) for i in range(60)]).withColumn("score", F.lit("kept"))
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    none = quality.fit(df, labels([]))
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}
    one = quality.fit(df, labels([(1, 1), (2, 1)]))
    assert {r.score for r in quality.score(df, one).collect()} == {1.0}
    out = quality.score(df, one, ("doc_id", "lang", "source"))
    assert out.columns == ["doc_id", "lang", "source", "score"]
    empty = df.where("false")
    assert quality.score(empty, quality.fit(empty, labels([]))).count() == 0
    assert np.isfinite(quality.fit(empty, labels([(1, 1), (2, 0)])).vectors).all()
    # a repeated labelled id counts once, with the least of its labels
    many = df.unionByName(df.where("doc_id < 4")).unionByName(df.where("doc_id < 4"))
    sample = quality._sampled(many, labels([(i, i % 2) for i in range(20)] + [(1, 0)]), quality.word_vectors(df), 6)
    assert len(sample) == len({s[0] for s in sample}) == 12 and all(s[1] == (s[0] % 2 if s[0] != 1 else 0) for s in sample)
