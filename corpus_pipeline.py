"""A training corpus from documents, in five stages; each works on all rows that the one before has kept.

1. toxicity: documents with toxic passages go (the label's probability is a half or more).
2. line_dedup: of near-equal lines, over all documents, one stays.
3. near_dedup: of each class of near-duplicate documents, one stays.
4. mixing: sources are brought to target weights; documents may stand several times, or not at all. The rows are stored in the mixture's order.
5. sentencepiece: the texts become ids of a public vocabulary.

Null texts are never toxic, lose no lines, are near duplicates of empty texts (rows of a null id aside, which always stay), carry no tokens (so they
stand in a mixture as often as their source's epochs) and have null ids. Empty tables give no rows. Of repeated rows, near_dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import lines, mixing, neardup, op8, spm, toxic
from quillon.llm.common import Scratch, documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't predicted toxic; columns as they were. The model is learned from the labelled rows of the tables. Null and empty texts stay."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return toxic.score(rows, op8.fitted(spark, sf_dir), ("row",)).where("predicted = 0").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that repeat others; n_chars, where there is such a column, follows the text. Null texts stay null; a text whose lines all go is empty."""
    left = lines.dedup_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, the one with the least id; null and empty texts are one class, rows of a null id stay."""
    return neardup.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mixture, in its order; no column of docs is replaced. A null source is one of its own, with the empty name; null and empty texts carry no tokens."""
    place = tuple("_" * max(map(len, docs.columns)) + c for c in mixing.PLACE)  # longer than any name there
    return mixing.in_order(mixing.mix(docs, place=place), place).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, number of ids, and the ids of every text; a null text has null ids and their number is null."""
    done = spm.encode(docs, spm.load(), ("doc_id", "source", "lang"))
    return done.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near), ("mixing", mix), ("sentencepiece", encode)]

#: SQL can't express the stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages give; each stage's rows are written once and read again, and what it stored on the way is deleted."""
    docs = documents(spark, sf_dir)
    with Scratch(spark) as all_:
        for _, stage in STAGES[:-1]:
            with Scratch(spark) as own:
                docs = own.keep(stage(spark, docs, sf_dir))
        all_.kept |= own.kept
    return STAGES[-1][1](spark, docs, sf_dir)
