"""The pipeline against what each stage must do, on a small corpus."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import spm

from .test_text_operators import DOCS, edited_words, words


def test_pipeline(spark, tmp_path):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        text = "\n".join(words(30, i * 10 + k) for k in range(3))
        bad = i % 4 == 0
        if bad:
            text += " " + " ".join(r.choice(["vilexx", "vileyy", "vilezz"]) for _ in range(6))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 0, int(bad)))
    rows.append((500, rows[1][1], "en", "s0", 1))
    near = edited_words(rows[2][1].replace("\n", " "), 1, 77)
    rows.append((501, near, "en", "s1", len(near)))
    rows += [(600, None, None, None, None), (601, "", "en", "s0", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    calm = stages["toxicity"](spark, df, str(tmp_path))
    assert calm.columns == df.columns
    ids = {x.doc_id for x in calm.collect()}
    assert {i for i in range(240) if i % 4} <= ids and sum(i in ids for i in range(0, 240, 4)) <= 3
    thin = stages["line_dedup"](spark, calm, str(tmp_path))
    assert thin.columns == df.columns and thin.count() == calm.count()
    assert thin.where("doc_id = 500").first().text == ""
    whole = stages["near_dedup"](spark, calm, str(tmp_path))
    left = {x.doc_id for x in whole.collect()}
    assert 1 in left and 500 not in left and 2 in left and 501 not in left and whole.columns == df.columns
    mixed = stages["mixing"](spark, whole, str(tmp_path))
    assert mixed.columns == df.columns
    out = stages["sentencepiece"](spark, mixed, str(tmp_path))
    assert out.count() == mixed.count()
    back = spm.decode(out.select("doc_id", "ids"), spm.load())
    assert back.join(whole.select("doc_id", F.col("text").alias("t")), "doc_id").where("NOT (text <=> t)").count() == 0
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert done.count() > 100 and "ids" in done.columns
    empty = df.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_stages_keep_columns_and_rows_of_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, two texts of one id, a very long text, names that the stages use themselves."""
    kind = DOCS + ", epoch string, block_order string, slot string, score string, row string, id string, label string, class_id string, predicted string"
    more = ("e", "b", "s", "sc", "r", "i", "l", "c", "p")
    texts = [(1, words(40, 1)), (1, words(40, 2)), (2, words(40, 3)), (2, words(40, 3)), (2, words(40, 3)), (3, None), (3, None), (4, ""), (None, words(30, 4)), (None, None), (5, words(40_000, 5)), (6, words(40, 6) + "\n" + words(40, 3))]
    rows = [(i, t, "en", s, None if t is None else len(t), *more) for (i, t), s in zip(texts, ["a", "a", "b", "b", "b", None, None, "a", "b", "a", "b", "a"], strict=True)]
    df = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name in ("toxicity", "line_dedup", "near_dedup", "mixing"):
        out = stages[name](spark, docs, str(tmp_path))
        assert [(c, t) for c, t in out.dtypes if c != "n_chars"] == [(c, t) for c, t in docs.dtypes if c != "n_chars"] and set(out.columns) == set(docs.columns)
        got = out.collect()
        assert all(tuple(r[c] for c in ("epoch", "block_order", "slot", "score", "row", "id", "label", "class_id", "predicted")) == more for r in got)
        ids = [r.doc_id for r in got]
        if name in ("toxicity", "line_dedup"):
            assert sorted(ids, key=str) == sorted((i for i, _ in texts), key=str)
        if name == "line_dedup":
            assert [r.text for r in got if r.doc_id == 2] == [words(40, 3)] * 3  # repeated rows are one document
            assert [r.text for r in got if r.doc_id == 6] == [words(40, 6)]
            assert sum(r.text is None for r in got) == 3
        if name == "near_dedup":
            assert ids.count(2) == 1 and ids.count(1) == 2 and ids.count(5) == 1 and ids.count(None) == 2
            assert sum(r.text in (None, "") and r.doc_id is not None for r in got) == 1
    ids = stages["sentencepiece"](spark, docs, str(tmp_path))
    assert ids.count() == len(texts) and ids.where("ids IS NULL").count() == 3 and ids.where("n_tokens > 20000").count() == 1
