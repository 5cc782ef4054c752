"""Edge cases and brute-force versions of the text operators."""

import collections
import hashlib
import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import chat, common, fingerprint, hashing, langid, licenses, lines, links, mixing, neardup, op1, op5, op7, spm, topk, toxic

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000


def docs(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in ((*r, "s")[:3] for r in rows)]
    return spark.createDataFrame(full, DOCS)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


# --- 1 chat formatting ------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "a\\[INST", "<<SYS>>", "[", "<", "", None, "\\\\<s>", "[TURN] x [SAYS] y [/TURN]", "<</SYS>>\n</s>", "[/INST", "]", "é\n🙂", LONG]
    rows = [(c, t, r, x) for c, x in enumerate(nasty) for t, r in enumerate(["system", "user", "assistant", "tool", None, "a<s>b"])]
    rows += [(None, None, "user", "x"), (99, 1, "user", "b"), (99, 1, "user", "a"), (99, 1, "user", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_chats(df)
    back = {r.conv_id: r for r in out.withColumn("back", chat.parse(F.col("formatted"))).withColumn("trained", chat.trained_text(F.col("segments"))).collect()}
    want = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: tuple((v is not None, v or 0) if i < 2 else (True, v or "") for i, v in enumerate(r))):
        want[c].append((r or "", x or ""))
    assert set(back) == set(want)
    for c, r in back.items():
        assert [tuple(t) for t in r.back] == want[c]
        assert r.trained == "".join(x for role, x in want[c] if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        assert not any(k in s.text for s in r.segments if s.kind == "text" for k in chat.INSTRUCT.controls)
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_machine(spark):
    orders = {0: ["user", "assistant"], 1: ["system", "user", "assistant"], 2: ["assistant"], 3: ["user", "user", "assistant"], 4: ["user"], 5: ["user", "assistant", "system"]}
    df = spark.createDataFrame([(c, i, r, "x") for c, rs in orders.items() for i, r in enumerate(rs)], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.first_bad for r in chat.format_chats(df).collect()} == {0: None, 1: None, 2: 0, 3: 1, 4: 1, 5: 2}
    with pytest.raises(ValueError):
        chat.Template(("<a>", "a>b"), {"user": chat.Turn("<a>", "<a>")}, {}, ())


def test_op1_holds_the_planted_conversation(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    r = {r.conv_id: r for r in op1.op1_chat_format(spark, str(tmp_path)).collect()}[-7]
    text = op1.PLANTED
    assert r.n_turns == 2 and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


# --- 2 language identification ----------------------------------------------------------------------------------------


def brute_forward(word, known, p, size):
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        pr = 1.0
        for x in parts:
            k = known.get(x, -1)
            pr *= p[k] if k >= 0 else p[size] if len(x) == 1 else 0.0
        total += pr
    return total


def test_forward_sums_all_segmentations():
    vocab = sorted({"▁", "▁a", "a", "b", "ab", "abc", "bc", "c", "▁abca"})
    known = langid.with_prefixes(vocab)
    p = np.random.default_rng(1).dirichlet(np.ones(len(vocab) + 1))
    ws = ["▁abcab", "▁x", "▁abcxa", "a"]
    got = langid.Lattice(known, ws, len(vocab)).logs(langid.scaled(p, vocab)[:, None])[:, 0]
    np.testing.assert_allclose(got, [math.log(brute_forward(w, known, p, len(vocab))) for w in ws], rtol=1e-10)


def test_long_words_are_summed_whole():
    """The sum in logarithms is that of the scaled pass, and expected uses agree; no length underflows."""
    vocab = sorted({"▁", "▁a", "a", "b", "ab", "abc", "bc", "c", "▁abca"})
    known = langid.with_prefixes(vocab)
    p = np.random.default_rng(1).dirichlet(np.ones(len(vocab) + 1), 2).T
    for w in ("▁abcab", "▁" + "abcxb" * 12):
        want = langid.Lattice(known, [w], len(vocab)).logs(langid.scaled(p, vocab))[0]
        np.testing.assert_allclose(langid.long_forward(w, known, len(vocab), np.log(p))[-1], want, rtol=1e-10)
        used = np.zeros(len(vocab) + 1)
        langid.long_expected(w, known, len(vocab), p[:, 0], 3.0, used)
        np.testing.assert_allclose(used, langid.Lattice(known, [w], len(vocab)).expected(langid.scaled(p[:, 0], vocab), np.array([3.0])), rtol=1e-8, atol=1e-12)
    assert np.isfinite(langid.long_forward("▁" + "abx" * 3000, known, len(vocab), np.log(p))[-1]).all()


def test_language_prediction(spark):
    r = random.Random(0)
    bank = {"aa": ["thing", "with", "the", "and"], "bb": ["schön", "und", "nicht", "über"]}
    rows = [(i, " ".join(r.choice(bank[x]) for _ in range(30)), x) for i in range(60) for x in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 40"))
    odd = [(100, None), (101, ""), (102, "123 !?"), (103, "THE thing " * 9000), (104, "über"), (104, "über"), (105, "x" * 5000), (106, "²x"), (107, "\u2167und"), (108, "²")]
    test = spark.createDataFrame([(*o, "zz", 1.0) for o in odd], "doc_id long, text string, lang string, score double")
    got = collections.defaultdict(list)
    assert langid.predict(test, model, ("doc_id", "lang", "score")).columns == ["doc_id", "lang", "score", "lang_pred", "score"]
    for p in langid.predict(test, model).collect():
        got[p.doc_id].append((p.lang_pred, p.score))
    assert [got[k][0][0] for k in (100, 101, 102, 103, 104, 108)] == ["und", "und", "und", "aa", "bb", "und"] and all(got[k][0][0] != "und" for k in (105, 106, 107)) and len(got[104]) == 2
    assert all(0 <= s <= 1 for v in got.values() for _, s in v)
    held = langid.predict(df.where("doc_id >= 40").select("doc_id", "text"), model).join(df, "doc_id")
    assert held.where("lang = lang_pred").count() == 20
    none = langid.fit(df.where("false"))
    assert langid.predict(df.select("doc_id", "text"), none).where("lang_pred = 'und'").count() == 60
    assert langid.predict(df.where("false").select("doc_id", "text"), model).count() == 0


# --- 3 licence scans --------------------------------------------------------------------------------------------------


def brute_base(text):
    ws = licenses.words(text)
    hits = [(i, label) for p, label in licenses.BASE for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    return len(ws), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_license_scan(spark):
    pool = "cc by general public license all rights reserved the gnu version".split()
    r = random.Random(4)
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts += [None, "", "ALL-RIGHTS reserved", "Éall rights reserved", "Licensed under the Apache License, Version 2.0.", "x " * 9000 + "CC BY-NC", "Released under the MIT License.", "Released under the MIT"]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df.select("doc_id", "text")).collect()}
    for i, t in enumerate(texts):
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute_base(t), t
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1
    assert "apache-2.0" in got[64].labels and "cc-by-nc" in got[65].labels and got[66].labels == "mit" and got[67].labels == ""


# --- 4 fingerprints ---------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    texts = [(5, "b" * 9), (1, "hello world, " * 20), (9, None), (3, "hello world, " * 20), (7, ""), (2, LONG), (4, "ab"), (4, "aa")]
    df = docs(spark, texts).repartition(3)
    got = sorted(fingerprint.with_next(df).collect(), key=lambda r: (r.doc_id, r.n_chars))
    order = sorted((i, t or "") for i, t in texts)
    want = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        want[i, hashlib.sha256(fingerprint.edited(t, nxt).encode()).hexdigest()] = (len(t), fingerprint.fingerprint(t), fingerprint.likeness(fingerprint.fingerprint(t), fingerprint.fingerprint(nxt)))
    assert {(r.doc_id, r.edited_sha256): (r.n_chars, r.fingerprint, r.near_next) for r in got} == want
    assert len(got) == len(texts) and all(0 <= r.near_edited <= 1 for r in got)
    assert fingerprint.with_next(df.where("doc_id = 1")).first().near_next == 1
    assert fingerprint.with_next(df.where("false")).count() == 0


# --- 5 mixing ---------------------------------------------------------------------------------------------------------


def test_mixing_weights_and_budget(spark):
    rows = [(i, words(20, i), "big") for i in range(300)] + [(1000 + i, words(20, i), f"s{i % 4}") for i in range(40)] + [(2000, None, None), (2001, "", "hollow"), (1, words(20, 1), "big")]
    df = docs(spark, rows)
    t = mixing.Target(entropy=0.9, repeats=6.0, seed=3)
    light = df.select(F.coalesce("source", F.lit("")).alias("source"), mixing.tokens(F.col("text")).alias("tokens"))
    p = {r.source: r for r in mixing.plan(light, t).collect()}
    shares = np.array([r.share for r in p.values()])
    entropy = lambda a: math.log((shares**a).sum()) - a * (shares**a * np.log(shares)).sum() / (shares**a).sum()
    lo, hi = 0.0, 1.0
    for _ in range(60):
        lo, hi = ((lo + hi) / 2, hi) if entropy((lo + hi) / 2) >= 0.9 * math.log(len(shares)) else (lo, (lo + hi) / 2)
    w = shares**lo / (shares**lo).sum()
    np.testing.assert_allclose([r.weight for r in p.values()], w, rtol=1e-6)
    assert set(p) == {"big", "s0", "s1", "s2", "s3"}
    out = mixing.mix(df, t)
    given = {r.source: r for r in out.groupBy("source").agg(F.sum(mixing.tokens(F.col("text"))).alias("tokens"), F.max("epoch").alias("e")).collect()}
    for s, r in p.items():
        assert r.goal - 25 <= given[s].tokens <= r.goal and given[s].e <= 6
    # an epoch holds a row once; the same rows come again
    assert out.groupBy("epoch", "doc_id", "text").count().where("count > 2").isEmpty()
    again = mixing.mix(df.repartition(7), t)
    key = lambda d: sorted((r.doc_id, r.epoch, r.block_order, r.slot) for r in d.collect())
    assert key(out) == key(again)
    assert mixing.mix(df.where("false"), t).count() == 0


def test_mixing_repeat_limit(spark):
    rows = [(i, words(10, i), "big") for i in range(200)] + [(1000, words(10, 7), "tiny")]
    p = {r.source: r for r in mixing.plan(docs(spark, rows).select("source", mixing.tokens(F.col("text")).alias("tokens")), mixing.Target(entropy=1.0, repeats=3.0)).collect()}
    assert p["tiny"].goal / p["tiny"].tokens == pytest.approx(3.0, abs=0.11)


def test_mixing_gives_only_the_repeated_rows_that_fit(spark, tmp_path):
    """A budget of 9 tokens, 6 for a source of repeated rows: two rows of three tokens, not all five. The SQL agrees."""
    import duckdb

    rows = [(1, "a b c", "x")] * 5 + [(2, "d e f", "y")] * 3
    target = mixing.Target(entropy=0.0, repeats=9.0, budget=9)
    got = mixing.mix(docs(spark, rows).withColumn("epoch", F.lit("own")), target).groupBy("source").count().collect()
    given = {r.source: 3 * r["count"] for r in got}
    goals = {r.source: r.goal for r in mixing.plan(docs(spark, rows).select("source", mixing.tokens(F.col("text")).alias("tokens")), target).collect()}
    assert given == {s: goals[s] // 3 * 3 for s in goals} and sum(given.values()) <= 9
    more = [(i // 3, words(5, i % 4), f"s{i % 2}" if i % 5 else "rare") for i in range(400)] + [(900, "one two three", "rare")] * 40
    docs(spark, more).repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(map(tuple, con.execute(f"SELECT doc_id, source, epoch, block_order, slot FROM ({op5.SQL})").fetchall()))
    assert sorted(map(tuple, op5.op5_mixing(spark, str(tmp_path)).collect())) == want
    ordered = [(r.epoch, r.block_order, r.slot) for r in mixing.in_order(op5.op5_mixing(spark, str(tmp_path))).collect()]
    assert ordered == sorted(ordered)


# --- 6 exact top-k ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("scale", [1.0, 2e4])
def test_top_k(spark, scale):
    g = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(g.normal(size=6) * 2, 1) * scale], 0) for i in range(250)]
    rows += [(300, None, 0), (301, [1.0, None, 0.0], 0), (302, [math.nan] * 6, 0), (303, [math.inf] * 6, 0), (304, [], 0), (305, [3.0], 0), (5, rows[5][1], 0), (400, [0.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3)
    got = collections.defaultdict(list)
    ready = df.where(topk.usable()).select("vec_id", topk.quantised().alias("values"))
    for r in topk.top_k(ready, F.col("vec_id") % 100 == 0, k=7, query_block=2).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {i: v for i, v in ints if i % 100 == 0}
    assert set(got) == set(queries)
    for q, v in queries.items():
        want = sorted(((sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ints if i != q), key=lambda x: (-x[0], x[1]))[:7]
        assert got[q] == [(i, s) for s, i in want]
    assert topk.top_k(ready.where("false"), F.col("vec_id") % 100 == 0).count() == 0


# --- 7 line dedup -----------------------------------------------------------------------------------------------------


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def line_set(x):
    n = lines.normal(x)
    return {n[i : i + lines.SHINGLE] for i in range(max(1, len(n) - lines.SHINGLE + 1))}


def brute_lines(rows):
    occ = [(i, k, x) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if lines.normal(x)]
    distinct = sorted({x for *_, x in occ})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {x: line_set(x) for x in distinct}
    for a, b in itertools.combinations(distinct, 2):
        if jaccard(sets[a], sets[b]) >= lines.REACH:
            root[find(a)] = find(b)
    doc = {i: hashlib.md5(t.encode()).hexdigest() for i, t in rows if t is not None}
    first = {}
    for i, k, x in occ:
        c = find(x)
        first[c] = min(first.get(c, (i, doc[i], k)), (i, doc[i], k))
    gone = {(i, k) for i, k, x in occ if first[find(x)] != (i, doc[i], k)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_line_dedup(spark):
    base = [words(40, s) for s in range(6)]
    near = base[0].replace(" ", "  ", 3).upper()
    changed = base[1][:-4] + "zzzz"
    rows = [(1, "\n".join([base[0], "short", "", base[1]])), (2, "\n".join([near, base[2], "short"])), (3, changed), (4, None), (5, ""), (6, base[3] + "\n" + base[3]), (7, LONG + "\n" + base[4]), (8, "   \n" + base[5]), (9, LONG)]
    df = docs(spark, rows).withColumn("n_lines", F.lit(1)).drop("n_lines")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert got == brute_lines(rows)
    assert got[2] == base[2] and got[3] == "" and got[4] is None
    assert lines.dedup_lines(df).columns == df.columns and lines.dedup_lines(df.where("false")).count() == 0
    twice = df.union(df.where("doc_id = 6"))
    assert [r.text for r in lines.dedup_lines(twice).where("doc_id = 6").collect()] == [base[3]] * 2


def test_op7_compares_short_lines(spark, tmp_path):
    """Exact copies of short lines go, blank lines stay; lines of one to eleven characters that differ stay."""
    rows = [(1, "Les.\nAnd ornd.\n\na"), (2, "Les.\n \nand  ORND.\nb\nWh the."), (3, "Wh the.\nLes.\na\n\nLes!")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_dropped, r.text_sha256) for r in op7.op7_line_dedup(spark, str(tmp_path)).collect()}
    want = {1: (0, rows[0][1]), 2: (2, " \nb\nWh the."), 3: (3, "\nLes!")}
    assert got == {i: (n, hashlib.sha256(t.encode()).hexdigest()) for i, (n, t) in want.items()}
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs(spark, rows), "").collect()} == {i: t for i, (_, t) in want.items()}


# --- 8 toxicity -------------------------------------------------------------------------------------------------------


def test_maximal_segments():
    r = np.random.default_rng(3)
    for _ in range(60):
        x = np.round(r.normal(-0.2, 1, size=r.integers(1, 14)), 2)
        got = toxic.segments(x)
        # the definition: the best segment, then the same left and right of it; ties to the shortest, then the first
        def parts(lo, hi):
            best = max(((x[a:b].sum(), a - b, -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None, key=lambda t: (round(t[0], 9), t[1], t[2]))
            if best is None or best[0] <= 1e-12:
                return []
            return [*parts(lo, best[3]), (best[3], best[4], best[0]), *parts(best[4], hi)]

        want = parts(0, len(x))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_segments_take_linear_time():
    """Rising and falling runs of 100,000 hits, the worst cases of a scan over earlier candidates."""
    for up, down in ((1.0, -1.1), (1.1, -1.0)):
        seconds = []
        for n in (50_000, 200_000):
            x = np.where(np.arange(n) % 2 == 0, up, down)
            began = time.process_time()
            found = toxic.segments(x)
            seconds.append(time.process_time() - began)
            assert len(found) == (n // 2 if down < -1 else 1)
        assert seconds[1] < 12 * seconds[0] + 0.2


def test_toxicity_against_brute_force(spark):
    """Scores, segments, E values and the label, written out from the definitions, on the held-out rows of a fixture."""
    r = random.Random(7)
    bank = words(400, 9).split()
    rows = []
    for i in range(900):
        ws = [r.choice(bank) for _ in range(r.randint(20, 70))]
        if i % 4 == 0:
            at = r.randrange(len(ws))
            ws[at:at] = ["nasty" + r.choice("abcde") for _ in range(r.randint(3, 6))]
        rows.append((i, " ".join(ws), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learn = df.where(~common.held_out())
    model = toxic.fit(learn.select("doc_id", "text"), learn.select("doc_id", "toxic"))
    got = {x.doc_id: x for x in toxic.score(df.where(common.held_out()).select("doc_id", "text"), model).collect()}
    assert len(got) > 100
    for i, text, label in rows:
        if i not in got:
            continue
        ws = text.lower().split()
        score = [model.odds.get(w, next((model.odds[w[:k] + "*"] for k in (5, 4, 3) if w[:k] + "*" in model.odds and len(w) >= k), -toxic.DRIFT)) for w in ws]

        def best(lo, hi, score=score):
            top = max(((math.fsum(score[a:b]), a - b, -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None, key=lambda t: (round(t[0], 9), t[1], t[2]))
            return [] if top is None or top[0] <= 1e-12 else [*best(lo, top[3]), (top[3], top[4] - 1, top[0]), *best(top[4], hi)]

        e = lambda s, n=len(ws): model.k * n * math.exp(-model.rate * s)
        want = [(a, b, s, e(s)) for a, b, s in best(0, len(ws)) if e(s) <= toxic.SIGNIFICANT]
        assert [(p.first_word, p.last_word) for p in got[i].passages] == [w[:2] for w in want]
        assert [p.score for p in got[i].passages] == pytest.approx([w[2] for w in want]) and [p.e_value for p in got[i].passages] == pytest.approx([w[3] for w in want], rel=1e-6)
        assert got[i].predicted == label, (i, got[i].score)


def test_rates_and_odds(spark):
    """Rates of words and beginnings, written out; keys are found by the hash that Spark gives them."""
    counts = {"a": (1, 0), "abc": (2, 1), "abcd": (0, 3), "abcdef": (4, 0), "äöüßé": (1, 1), "日本語": (0, 2), "xyz9": (0, 1)}
    base, s = 0.4, toxic.STRENGTH
    rate = lambda n, parent: (n[0] + s * parent) / (n[0] + n[1] + s)
    want = {"": base}
    for level in (3, 4, 5):
        for stem in {w[:level] for w in counts if len(w) >= level}:
            n = [sum(c[i] for w, c in counts.items() if w[:level] == stem and len(w) >= level) for i in (0, 1)]
            want[stem + "*"] = rate(n, want[stem[: level - 1] + "*"] if level > 3 else base)
    for w, n in counts.items():
        want[w] = rate(n, want[w[: min(len(w), 5)] + "*"] if len(w) >= 3 else base)
    del want[""]
    got = toxic.rates(spark.createDataFrame([(w, *n) for w, n in counts.items()], "word string, toxic long, other long"), base).toPandas()
    odds = toxic.Odds(got["key"].to_numpy(), got["rate"].to_numpy())
    assert len(got) == len(want) and all(odds[k] == pytest.approx(v) for k, v in want.items())
    assert "abcx" not in odds and odds.get("abcx", 7.0) == 7.0 and not toxic.Odds(np.empty(0, np.int64), np.empty(0)).of(["a"]) > 0
    model = toxic.Model(odds)
    assert model.look_up(["abcd", "abcdz", "abcxy", "q"]) == pytest.approx([want["abcd"], want["abcd*"], want["abc*"], -toxic.DRIFT])


def test_karlin():
    v, w = np.array([2.0, -1.0]), np.array([0.2, 0.8])
    rate = toxic.karlin(v, w)
    assert (w * np.exp(rate * v)).sum() == pytest.approx(1)


def test_toxicity(spark):
    r = random.Random(5)
    calm = [w for w in words(300, 1).split()]
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        body = [r.choice(calm) for _ in range(80)]
        if bad:
            for _ in range(5):
                body.insert(r.randrange(80), "vile" + r.choice(["xx", "yy", "zz", "ww"]))
        rows.append((i, " ".join(body), int(bad)))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    lab = spark.createDataFrame([*labels, (None, 1), (0, 0)], "doc_id long, toxic int")
    model = toxic.fit(df.where("doc_id < 400").select("doc_id", "text"), lab.where("doc_id < 400"), per_class=200)
    got = toxic.score(df.where("doc_id >= 400"), model, ("doc_id", "truth"))
    assert got.where("predicted <> truth").count() <= 2
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "vilexx " * 3), (4, LONG), (4, LONG), (None, "x")], "score long, text string")
    out = toxic.score(odd, model, ("text",)).collect()
    assert len(out) == 6 and all(0 <= x.score <= 1 for x in out)
    assert next(x for x in out if x.text and x.text.startswith("vile")).passages[0].first_word == 0
    empty = toxic.fit(df.where("false").select("doc_id", "text"), lab)
    assert toxic.score(df.limit(5).select("doc_id", "text"), empty).where("predicted = 1").count() == 0


# --- 9 near duplicates ------------------------------------------------------------------------------------------------


def shingle_set(t):
    ws = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def shingle_list(t):
    ws = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    return [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]


def edited_words(t, k, seed):
    r, ws = random.Random(seed), t.split()
    for i in r.sample(range(len(ws)), k):
        ws[i] = words(1, seed * 100 + i)
    return " ".join(ws)


def test_near_duplicates(spark):
    rows, n = [], 0
    for g in range(8):
        base = words(200, g)
        for k in (0, 0, 1, 2, 3, 6, 15, 40):
            rows.append((n, edited_words(base, k, n) if k else base))
            n += 1
    rows += [(900, None), (901, ""), (902, "..."), (903, "one two"), (904, "ONE, two!"), (905, LONG), (906, LONG + "tail"), (3, rows[3][1]), (907, rows[5][1]), (907, rows[20][1])]
    df = docs(spark, rows).repartition(5)
    found = {(r.id, r.content): r.class_id for r in neardup.classes(df).collect()}
    items = [(i, t or "") for i, t in rows]
    key = lambda i, t: (i, hashlib.md5(t.encode()).hexdigest())
    sets = [shingle_set(t) for _, t in items]
    for (a, ta), sa in zip(items, sets, strict=True):
        for (b, tb), sb in zip(items, sets, strict=True):
            if ta == tb or (sa and jaccard(sa, sb) >= 0.82):
                assert found[key(a, ta)] == found[key(b, tb)], (a, b, jaccard(sa, sb))
            elif jaccard(sa, sb) < 0.1 and a < 900 and b < 900:
                assert found[key(a, ta)] != found[key(b, tb)], (a, b)
    assert found[key(903, "one two")] == found[key(904, "ONE, two!")] == 903
    kept = neardup.one_of_each(df)
    classes = {c for c in found.values()}
    assert kept.count() == len(classes) and kept.columns == df.columns
    assert neardup.one_of_each(df.where("false")).count() == 0
    nulls = docs(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f")])
    assert neardup.one_of_each(nulls).count() == 3
    alone = docs(spark, [(None, "g h i j k l"), (1, "a b c d e f"), (None, None)])
    assert sorted((r.id or 0, r.class_id or 0) for r in neardup.classes(alone).collect()) == [(0, 0), (0, 0), (1, 1)]


def test_near_copies_in_a_hot_group(spark):
    """A third of the rows are copies of one text; near copies of it (3 and 4 edited words of 200) are linked to it all the same."""
    base = words(200, 1)
    apart = lambda ks: " ".join(f"edited{i}" if i in ks else w for i, w in enumerate(base.split()))
    hot = [apart({20, 90, 160}), apart({20, 70, 120, 170})]
    rows = [(i, base) for i in range(100)] + [(100 + i, t) for i, t in enumerate(hot)] + [(200 + i, words(200, 1000 + i)) for i in range(198)]
    assert all(0.81 < jaccard(shingle_set(base), shingle_set(t)) < 0.87 for t in hot)
    got = {r.id: r.class_id for r in neardup.classes(docs(spark, rows)).collect()}
    assert got == {i: 0 if i < 200 else i for i, _ in rows}


def test_real_idf_decides_links(spark):
    """Pairs that share rare words but not their frequent notices are alike by weight only; copies of a text don't count twice. All pairs against brute force."""
    notices = [words(20, 900 + i) for i in range(2)]
    rows = [(i, words(140, i) + " " + notices[i % 2]) for i in range(24)]
    rows += [(50 + i, words(140, i) + " " + notices[1 - i % 2]) for i in range(4)]  # the same, with the other notice
    rows += [(60 + k, edited_words(rows[10 + k][1], e, 5000 + k)) for k, e in enumerate((2, 4, 5, 6, 7, 8, 9, 10, 12))]
    rows += [(100 + i, words(60, 2000 + i)) for i in range(560)] + [(1000 + i, rows[1][1]) for i in range(200)]
    df = docs(spark, rows).repartition(6)
    texts = {t for _, t in rows}
    counts = collections.Counter(s for t in texts for s in shingle_set(t))
    assert len(counts) > 1 and max(counts.values()) * 20 < len(texts)  # all below one text in twenty
    idf = {s: math.log(1 + len(texts) / c) for s, c in counts.items()}

    def weighted(a, b):
        x, y = ({s: t * idf[s] for s, t in collections.Counter(shingle_list(v)).items()} for v in (a, b))
        return sum(min(x[s], y[s]) for s in x.keys() & y.keys()) / sum(max(x.get(s, 0), y.get(s, 0)) for s in x.keys() | y.keys())

    first = {t: i for i, t in sorted(((i, t) for i, t in rows), reverse=True)}
    items = sorted((i, t) for t, i in first.items() if i < 100)
    for plain in (False, True):
        root = {i: i for i, _ in items}
        for x, (a, ta) in enumerate(items):
            for b, tb in items[x + 1 :]:
                if weighted(ta, tb) >= 0.8 or plain and jaccard(shingle_set(ta), shingle_set(tb)) >= 0.8:
                    old, own = max(root[a], root[b]), min(root[a], root[b])
                    root = {k: own if v == old else v for k, v in root.items()}
        got = {r.id: r.class_id for r in neardup.classes(df, plain=plain).collect()}
        assert {i: got[i] for i in root} == root and all(got[1000 + i] == got[1] for i in range(200))
        assert all(root[50 + i] == i and jaccard(shingle_set(rows[i][1]), shingle_set(rows[24 + i][1])) < 0.79 for i in range(4))
    w = neardup.weights(df)
    assert w.n == len(texts) and sorted(w.df.tolist()) == sorted(c for c in counts.values() if c > 1)


def test_clip_does_not_depend_on_size(spark):
    """Over a million shingles above the clip keep their frequencies."""
    n = 1_000_100
    text = " ".join(map(str, range(n)))
    w = neardup.weights(docs(spark, [(1, text), (2, text + " more")]))
    assert len(w.keys) == n - 4 and w.common == pytest.approx(math.log(3)) and np.allclose(w.idf, math.log(2))


def test_links_between_members_of_a_bucket_that_miss_the_leader(spark, monkeypatch):
    """Item 0 leads one bucket of all; the others are a chain in which only neighbours are alike. Every link must be found."""
    size, step = 40, 4
    sets = {i: set(range(1000 + i * step, 1000 + i * step + size)) for i in range(1, 40)} | {0: set(range(size))}
    bodies = spark.createDataFrame([(i, ",".join(map(str, sorted(s)))) for i, s in sets.items()], "id long, body string")
    members = bodies.select(F.lit(1).cast("long").alias("bucket"), "id")

    def features(c):
        got = [np.array(sorted(map(int, x.split(","))), np.uint64) for x in c.to_pylist()]
        return np.repeat(np.arange(len(got)), [len(x) for x in got]), np.concatenate(got), np.ones(sum(map(len, got)))

    def verify(batches):
        for b in batches:
            x, y = ([set(t.split(",")) for t in b.column(i).to_pylist()] for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(p & q) / len(p | q) for p, q in zip(x, y, strict=True)], pa.float64())], ["a", "b", "similarity"])

    for block, rounds, spread, salt_rows, small in ((7, 0, 4, 3, 1), (7, 3, 0, 2000, 1), (256, 6, 4, 2000, 64)):
        for name, value in (("BLOCK", block), ("ROUNDS", rounds), ("SPREAD", spread), ("SALT_ROWS", salt_rows), ("SMALL", small)):
            monkeypatch.setattr(links, name, value)
        got = {r.id: r.root for r in links.components(links.linked(members, bodies, verify, features, 0.8)).collect()}
        assert got == {i: 1 for i in range(1, 40)}


def test_only_tables_of_results_stay_stored(spark):
    """Of what line and near dedup and components store on their way, only the table that the result reads is left, and it can be read."""
    df = docs(spark, [(i, words(60, i // 2) + ("\n" + words(40, i) if i % 2 else "")) for i in range(12)])
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    for run, rows in ((lambda: lines.dedup_lines(df), 12), (lambda: neardup.classes(df), 12), (lambda: neardup.one_of_each(df), 12), (lambda: links.components(edges), 5)):
        before = list(common._stored)
        out = run()
        assert common._stored[:-1] == before and out.count() == rows


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(35)] + [(200, 200), (300, 301), (301, 300)]
    got = {x.id: x.root for x in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {v: find(v) for v in root if v != 200}


def test_sampling_estimates_weighted_jaccard():
    g = np.random.default_rng(0)
    keys = hashing.mix(np.arange(1, 401, dtype=np.uint64))
    sampler = neardup.Sampler(2.0)
    agree = total = 0
    for _ in range(12):
        wa, wb = np.where(g.random(400) < 0.5, 2.0, g.choice([1.0, 4.0], 400)), np.where(g.random(400) < 0.5, 2.0, g.choice([1.0, 4.0], 400))
        _, a = sampler.samples(np.zeros(400, int), np.sort(keys), wa, 1)
        _, b = sampler.samples(np.zeros(400, int), np.sort(keys), wb, 1)
        agree += (a == b).mean()
        total += np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        keys = hashing.mix(keys)
    assert agree / 12 == pytest.approx(total / 12, abs=0.06)


# --- 10 SentencePiece -------------------------------------------------------------------------------------------------

ODD = ["", " ", "  two  spaces", "日本語 text\n\ttab", "🙂🙂 ok", "aaaaaaaaaa aaaa", "The quick brown fox; jumps 12,345 times!", "naïve café ÀÉÎ", "\0 nul", LONG[:5000]]


def test_ids_are_those_of_the_library():
    model = spm.load()
    texts = ODD + [words(200, s) for s in range(5)]
    library = sentencepiece.SentencePieceProcessor(model_file=spm.VOCABULARY)
    encoder = spm.Encoder(model)
    assert encoder.encode_batch(texts) == library.encode(texts)
    assert [encoder.decode(x) for x in encoder.encode_batch([*texts, "a▁b ▁", None])] == [*texts, "a▁b ▁", None]


def test_unigram_pass_is_the_best_path():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "bab", "▁ab"]
    model = spm.Model(pieces, [0, -3.0, -2.0, -2.5, -2.2, -3.1, -2.9, -4.0, -3.3], "unigram", [], [False] + [True] * 8)
    encoder = spm.Encoder(model)
    for text in ("abab", "ba", "bbab", "aab bab"):
        ids = encoder.encode_batch([text])[0]
        marked = "▁" + text.replace(" ", "▁")

        def best(s):
            return max((model.scores[model.ids[s[:k]]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in model.ids), default=-math.inf) if s else 0.0

        assert sum(model.scores[i] for i in ids) == pytest.approx(best(marked)) and encoder.decode(ids) == text


def test_encoding_tables(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*ODD, None, ODD[3]])], "doc_id long, text string, ids int")
    model = spm.load()
    out = spm.encode(df.drop("ids"), model, ("doc_id",), check=True)
    back = {r.doc_id: r for r in spm.decode(out.select("doc_id", "ids"), model).collect()}
    assert {k: r.text for k, r in back.items()} == dict(enumerate([*ODD, None, ODD[3]]))
    assert out.where("decoded IS NULL").count() == 1 and spm.encode(df.where("false"), model).count() == 0


# --- shared -----------------------------------------------------------------------------------------------------------


def test_bounded_sample(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).alias("label"))
    got = common.bounded_sample(df, "label", 100)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {True: 100, False: 100}
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in common.bounded_sample(df.repartition(9), "label", 100).collect())


def test_word_hashes_do_not_depend_on_place():
    texts = pa.array(["a b c", "c b a", None, "x" * 50 + " b", "É b"])
    data, offsets = hashing.buffers(texts.slice(0))
    row, h = hashing.word_hashes(data, offsets)
    assert row.tolist() == [0, 0, 0, 1, 1, 1, 3, 3, 4, 4]
    assert h[0] == h[5] and h[1] == h[4] == h[7] == h[9] and len(set(h.tolist())) == 5


def test_settled_components_take_no_round(spark, monkeypatch):
    """Edges that are stars around their least ids are stored once and tested; other graphs still end in stars."""
    kept = []
    monkeypatch.setattr(common.Scratch, "only", lambda self, df, f=common.Scratch.only: (kept.append(1), f(self, df))[1])
    stars = [(10, 1), (11, 1), (1, 12), (20, 2), (2, 20), (21, 2), (3, 3)]
    assert {x.id: x.root for x in links.components(spark.createDataFrame(stars, "a long, b long")).collect()} == {1: 1, 10: 1, 11: 1, 12: 1, 2: 2, 20: 2, 21: 2}
    assert len(kept) == 2  # the edges and the result
    path = [(i, i + 1) for i in range(30)] + [(40, 50), (41, 50), (41, 60)]
    assert {x.id: x.root for x in links.components(spark.createDataFrame(path, "a long, b long")).collect()} == dict.fromkeys(range(31), 0) | dict.fromkeys((40, 41, 50, 60), 40)
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_asked_for_are_sent_as_eight_bytes_each(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(lines, "_fetcher", lambda shared, f=lines._fetcher: (sent.append(shared.value), f(shared))[1])
    texts = [words(60, 5) + "\n\n" + words(60, 6), words(60, 6) + "\n" + words(60, 7), "", None, words(60, 5) + "x"]
    got = lines.dedup_lines(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)).collect()
    assert {r.doc_id: r.text for r in got} == {0: texts[0], 1: words(60, 7), 2: "", 3: None, 4: ""}
    assert len(sent) == 1 and isinstance(sent[0], np.ndarray) and sent[0].nbytes == 8 * len(sent[0]) and len(sent[0]) >= 2


def test_encoding_takes_memory_by_chunk():
    """A large batch is encoded in parts, so what the arrays of a pass take doesn't grow with the batch."""
    import tracemalloc

    text = pa.array([words(2000, i % 7) for i in range(600)])
    encoder = spm.Encoder(spm.load())
    encoder.arrow(text.slice(0, 10))
    tracemalloc.start()
    encoder.arrow(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text.nbytes > 6e6 and peak < 100e6, (text.nbytes, peak)
