"""Bootstrap of tables of any size (below 2^32 rows): the same draws as resample, made block by block in many tasks and joined to the rows.

Whether a word of a draw's stream is rejected depends on the word alone, so a block of words can be read anywhere: one pass counts the words that each block
keeps, running sums of these counts (a row for each draw and block) say which positions a block fills, and a second pass makes them. Nothing of the table is
broadcast or goes through the driver, but its number of rows. Names of helper columns start with an underscore.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import rng
from quillon.operators.errors import DomainError, TooFewObservations
from quillon.operators.order import numbered
from quillon.operators.storage import stored

#: Words of a block.
BLOCK = 1 << 16
#: Blocks that a task makes, about.
BLOCKS_A_TASK = 32
#: Standard deviations of the number of rejected words that are read beyond the expected number. If they don't suffice, twice as many words are read.
SPARE = 12.0
#: Drawn rows that a task joins, about.
DRAWN_A_TASK = 1 << 20


def _kept(table: DataFrame, n: int, seed: int, block: int) -> DataFrame:
    """(_draw, _block) rows with the number of words of the block that aren't rejected."""

    def run(batches):
        for b in batches:
            got = [len(rng.bounded_words(seed, d, n, k * block, block)) for d, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.int64())], ["_draw", "_block", "_kept"])

    return table.mapInArrow(run, "_draw long, _block long, _kept long")


def _spread(spark: SparkSession, blocks: int) -> int:
    """Partitions for a number of blocks."""
    return max(1, min(blocks, max(spark.sparkContext.defaultParallelism, blocks // BLOCKS_A_TASK)))


def block_offsets(spark: SparkSession, n: int, draws: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(_draw, _block, _before): the blocks that hold the first n integers of each draw, and how many of them stand in earlier blocks. The table is stored."""
    if not 0 < n < 1 << 32:
        raise DomainError("the number of rows must be positive and fit 32 bits")
    lost = ((1 << 32) % n) / 2.0**32
    tries = max(1.0, n / (1 - lost) + SPARE * math.sqrt(n * lost) / (1 - lost))
    while True:
        per_draw = math.ceil(tries / block)
        ids = spark.range(0, draws * per_draw, 1, _spread(spark, draws * per_draw))
        counts = stored(_kept(ids.select(F.expr(f"id div {per_draw}").alias("_draw"), F.expr(f"id % {per_draw}").alias("_block")), n, seed, block))
        if counts.groupBy("_draw").agg(F.sum("_kept").alias("_all")).where(F.col("_all") < n).isEmpty():
            break
        tries *= 2
    before = Window.partitionBy("_draw").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return stored(counts.select("_draw", "_block", F.coalesce(F.sum("_kept").over(before), F.lit(0)).alias("_before")).where(F.col("_before") < n))


def drawn_rows(spark: SparkSession, n: int, draws: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(_draw, _pos, _row): the row that stands at each position of each draw, both from 0."""
    table = block_offsets(spark, n, draws, seed, block)

    def run(batches):
        for b in batches:
            for d, k, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = rng.bounded_words(seed, d, n, k * block, block)[: n - at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), d, np.int64)), pa.array(np.arange(at, at + len(rows))), pa.array(rows.astype(np.int64))], ["_draw", "_pos", "_row"])

    dealt = table.repartition(_spread(spark, draws * math.ceil(n / block)), "_draw", "_block")  # a number of its own: AQE would put the small table into one task
    return dealt.mapInArrow(run, "_draw long, _pos long, _row long")


def _joined(base: DataFrame, by: list[str], draws: int, seed: int, block: int) -> DataFrame:
    """resampled, with the number of the row as _row. The rows of a number lie in one partition, of all draws.

    Spark takes the drawn rows for as small as the table of blocks that they are made from, and would broadcast them; the hint has it shuffle both sides. What a task
    joins stays of one size.
    """
    clash = {"_draw", "_pos", "_row", "_by", "_g", "_x", "_id", "_at", "_part", "_first", "rows", "rows_off"} & {c.lower() for c in base.columns}
    if clash:
        raise DomainError(f"columns of the base would be replaced: {sorted(clash)}")
    rows = stored(numbered(base, *by, out="_row"))
    n = rows.count()
    if not n:
        raise TooFewObservations(1, 0)
    drawn = drawn_rows(base.sparkSession, n, draws, seed, block).repartition(max(1, draws * n // DRAWN_A_TASK), "_row")
    return drawn.join(rows.hint("shuffle_hash"), "_row")


def resampled(base: DataFrame, by: list[str], draws: int, seed: int, block: int = BLOCK) -> DataFrame:
    """The base's columns with _draw and _pos: every draw's rows, taken with replacement from the rows in the order of the columns by.

    Rows are joined by their number; each is drawn about once a draw, so no key is hot. A base of no rows is an error. Nulls in any column are kept; equal
    rows are rows of their own. Columns named _draw, _pos, _row, _by, _g, _x, _id, _at, _part, _first, rows or rows_off aren't allowed in the base.
    """
    return _joined(base, by, draws, seed, block).drop("_row")


def bootstrap(base: DataFrame, by: list[str], draws: int, seed: int, *statistics: Column, block: int = BLOCK) -> DataFrame:
    """draw and the statistics, which are aggregates of the base's columns, _pos and _row (a row's number in the base), of every draw. Spark sums up in each task before it shuffles."""
    done = _joined(base, by, draws, seed, block).groupBy("_draw").agg(*statistics)
    return done.select(F.col("_draw").alias("draw"), *(c for c in done.columns if c != "_draw"))
