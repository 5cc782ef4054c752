"""Mixing sources to target weights by a temperature, realised as budgeted block permutations. Native: DataFrame functions only.

The token shares of the sources are raised to an exponent in [0, 1] and normalised. The exponent is found by bisection (each pass over the
table of sources evaluates several levels of halving at once): the largest whose entropy reaches the target, or, where that
would repeat a source more often than the limit, the least that keeps the limit.

A source of weight w gets w x budget tokens: whole epochs of all its documents, then part of one more. Documents are dealt into blocks by
a hash; every epoch orders the blocks, and the documents in a block, by hashes of its own. The part epoch takes whole blocks in that order
while they fit; of the block that doesn't, it takes documents in order while they fit. Running sums go over blocks, in two levels (ranges of the
order, then the blocks of a range), and over the documents of one block for each source, never over all documents of a source.

Defined results: a null source is the empty source; a null text has no tokens; sources without tokens get no weight and no copies; ties
in a hash go to the smaller id, then to fewer tokens; repeated rows are rows of their own, of which as many are given as fit; an empty table gives no rows; all
columns come back, and epoch, block_order and slot (the order of blocks and of documents in the epoch), which take the place of columns of these
names; names of helper columns start with "_mix_".
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import stored

BLOCK_ROWS = 2048
#: Bits of the ranges of block orders that running sums go over first.
RANGE_BITS = 8
#: Levels of halving that one pass evaluates, and passes.
LEVELS, PASSES = 4, 9
#: Rows of the source and block tables that are broadcast at most; more are joined by a shuffle.
BROADCAST = 200_000


@dataclass(frozen=True)
class Target:
    """entropy: share of ln(number of sources) to reach; repeats: most copies of a document on average; budget: tokens in all, by default as many as there are."""

    entropy: float = 0.95
    repeats: float = 4.0
    budget: int | None = None
    seed: int = 7


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def hashed(*parts: Column | str | int) -> Column:
    """A number from 0 to 2 ** 60 - 1, from the MD5 of the parts."""
    text = F.concat_ws("|", *(x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _bisected(stats: DataFrame, high_enough) -> float:
    """The largest exponent in [0, 1] of which high_enough(a, sum p^a, sum p^a ln p, max p^(a-1)) holds; it holds for small ones. 0 if for none."""
    lo, hi, width = 0.0, 1.0, 1 << LEVELS
    for n in range(PASSES):
        points = [lo + (hi - lo) * i / width for i in range(0 if n == 0 else 1, width + (n == 0))]
        p = F.col("share")
        row = stats.agg(*(F.array(F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)), F.max(F.pow(p, F.lit(a - 1)))).alias(str(i)) for i, a in enumerate(points))).first()
        holds = [high_enough(a, *row[str(i)]) for i, a in enumerate(points)]
        if n == 0 and holds[-1]:
            return 1.0
        if n == 0 and not holds[0]:
            return 0.0
        good = [a for a, ok in zip(points, holds, strict=True) if ok]
        step = (hi - lo) / width
        lo, hi = (good[-1] if good else lo), min(hi, (good[-1] if good else lo) + step)
    return lo


def exponent(stats: DataFrame, target: Target, budget: float) -> float:
    """The exponent for a table of sources with share and tokens, to nine digits."""
    k, total = stats.agg(F.count("*"), F.sum("tokens")).first()
    if not k:
        return 1.0
    goal = target.entropy * math.log(k)
    by_entropy = _bisected(stats, lambda a, z, s, _: math.log(z) - a * s / z >= goal)
    # the repetition limit: copies fall as the exponent rises, so the least exponent is 1 minus the largest 1 - a
    over = budget / total
    mirrored = _bisected_from_one(stats, lambda a, z, top: over * top / z <= target.repeats)
    return round(max(by_entropy, mirrored), 9)


def _bisected_from_one(stats: DataFrame, holds) -> float:
    """The least exponent in [0, 1] of which holds(a, sum p^a, max p^(a-1)) is true; it is true for large ones. 1 if for none."""
    lo, hi, width = 0.0, 1.0, 1 << LEVELS
    for n in range(PASSES):
        points = [lo + (hi - lo) * i / width for i in range(0 if n == 0 else 1, width + (n == 0))]
        p = F.col("share")
        row = stats.agg(*(F.array(F.sum(F.pow(p, F.lit(a))), F.max(F.pow(p, F.lit(a - 1)))).alias(str(i)) for i, a in enumerate(points))).first()
        ok = [holds(a, *row[str(i)]) for i, a in enumerate(points)]
        if n == 0 and (ok[0] or not ok[-1]):
            return 0.0 if ok[0] else 1.0
        good = [a for a, x in zip(points, ok, strict=True) if x]
        step = (hi - lo) / width
        hi = good[0] if good else hi
        lo = max(lo, hi - step)
    return hi


def plan(light: DataFrame, target: Target) -> DataFrame:
    """Of (source, tokens) rows: source, n_docs, tokens, share, weight, goal (tokens to give), whole (epochs), part (tokens of the part epoch), blocks."""
    stats = stored(light.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens")).where("tokens > 0"))
    total = stats.agg(F.sum("tokens")).first()[0] or 0
    budget = total if target.budget is None else target.budget
    stats = stats.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    a = exponent(stats, target, budget)
    z = stats.agg(F.sum(F.pow("share", F.lit(a)))).first()[0] or 1.0
    return (
        stats.withColumn("weight", F.pow("share", F.lit(a)) / F.lit(z)).withColumn("goal", F.round(F.col("weight") * budget).cast("long"))
        .withColumn("whole", F.floor(F.col("goal") / F.col("tokens")).cast("long")).withColumn("part", F.col("goal") - F.col("whole") * F.col("tokens"))
        .withColumn("blocks", F.ceil(F.col("n_docs") / BLOCK_ROWS).cast("long"))
    )


#: Columns of a mixture: the epoch (from 0), and the order of blocks within it and of rows within a block.
PLACE = ("epoch", "block_order", "slot")


def mix(docs: DataFrame, target: Target | None = None, key: str = "doc_id", source: str = "source", text: str = "text", place: tuple[str, str, str] = PLACE) -> DataFrame:
    """The rows of the mixture: docs with three columns of their place, which replace columns of those names."""
    target = target or Target()
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    light = stored(docs.select(F.col(key).alias("id"), name.alias("source"), tokens(F.col(text)).alias("tokens")))
    sources = stored(plan(light, target))
    few = F.broadcast if sources.count() <= BROADCAST else (lambda x: x)
    block = F.pmod(hashed(target.seed, "block", F.col("id")), F.col("blocks"))
    order = hashed(target.seed, "order", F.col("epoch"), F.col("source"), F.col("block"))
    dealt = light.join(few(sources.select("source", "blocks", "whole", "part")), "source").withColumn("block", block)

    sums = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"), F.max("whole").alias("epoch"), F.max("part").alias("part"))
    blocks = stored(sums.withColumn("block_order", order).withColumn("range", F.shiftright("block_order", 60 - RANGE_BITS)))
    upper = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.groupBy("source", "range").agg(F.sum("block_tokens").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(upper), F.lit(0))).drop("t")
    running = Window.partitionBy("source", "range").orderBy("block_order", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.join(before, ["source", "range"]).withColumn("upto", F.col("before") + F.sum("block_tokens").over(running))
    blocks = stored(blocks.withColumn("room", F.col("part") - (F.col("upto") - F.col("block_tokens"))).where("room >= 0"))
    # of each source: the blocks that fit, and the first that doesn't
    cut = blocks.where("upto > part").groupBy("source").agg(F.min(F.struct("block_order", "block")).alias("cut"))
    blocks = blocks.join(cut, "source", "left").withColumn("is_cut", F.coalesce(F.struct("block_order", "block") == F.col("cut"), F.lit(False)))
    blocks = stored(blocks.where("upto <= part OR is_cut").select("source", "block", "is_cut", "room"))
    some = F.broadcast if blocks.count() <= BROADCAST else (lambda x: x)

    # rows of the cut blocks, one block for each source: how many of each (id, tokens) still fit
    slot = hashed(target.seed, "slot", F.col("whole"), F.col("id"))
    within = Window.partitionBy("source", "block").orderBy("slot", "id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fitting = dealt.join(some(blocks.where("is_cut").select("source", "block", "room")), ["source", "block"])
    fitting = fitting.groupBy("source", "block", "id", "tokens", "whole", "room").agg(F.count("*").alias("rows")).withColumn("slot", slot)
    fitting = fitting.withColumn("left", F.col("room") - F.sum(F.col("rows") * F.col("tokens")).over(within) + F.col("rows") * F.col("tokens"))
    fits = F.when(F.col("left") < 0, 0).when(F.col("tokens") == 0, F.col("rows")).otherwise(F.least("rows", F.floor(F.col("left") / F.col("tokens"))))
    fitting = stored(fitting.withColumn("fits", fits.cast("long")).where("fits > 0").select(F.col("id").alias("_mix_id"), F.col("source").alias("_mix_fs"), F.col("tokens").alias("_mix_ft"), "rows", "fits"))

    own = docs.withColumn("_mix_source", name).join(few(sources.select(F.col("source").alias("_mix_known"), F.col("blocks").alias("_mix_blocks"), F.col("whole").alias("_mix_whole"))), F.col("_mix_source") == F.col("_mix_known"))
    own = own.withColumn("_mix_block", F.pmod(hashed(target.seed, "block", F.col(key)), F.col("_mix_blocks")))
    marks = blocks.select(F.col("source").alias("_mix_bs"), F.col("block").alias("_mix_bb"), F.col("is_cut").alias("_mix_cut"))
    own = own.join(some(marks), (F.col("_mix_source") == F.col("_mix_bs")) & (F.col("_mix_block") == F.col("_mix_bb")), "left")
    own = own.withColumn("_mix_tokens", F.when(F.col("_mix_cut"), tokens(F.col(text))))
    near = F.broadcast if fitting.count() <= BROADCAST else (lambda x: x)
    counts = fitting.select("_mix_id", "_mix_fs", "_mix_ft", F.col("rows").alias("_mix_rows"), F.col("fits").alias("_mix_fits"))
    own = own.join(near(counts), F.col(key).eqNullSafe(F.col("_mix_id")) & (F.col("_mix_source") == F.col("_mix_fs")) & (F.col("_mix_tokens") == F.col("_mix_ft")), "left")
    if not fitting.where("fits < rows").isEmpty():  # repeated rows of which some fit: at most one (id, tokens) of each source
        torn = F.coalesce(F.col("_mix_fits") < F.col("_mix_rows"), F.lit(False))
        order_ = Window.partitionBy("_mix_source", key, "_mix_tokens").orderBy(F.md5(text))
        some_fit = own.where(torn).withColumn("_mix_fits", F.when(F.row_number().over(order_) <= F.col("_mix_fits"), F.col("_mix_fits")))
        own = own.where(~torn).unionByName(some_fit)
    copies = F.col("_mix_whole") + F.when((F.col("_mix_bs").isNotNull() & ~F.col("_mix_cut")) | F.col("_mix_fits").isNotNull(), 1).otherwise(0)
    out = own.withColumn("_mix_copies", copies).where("_mix_copies > 0").withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_copies") - 1)))
    e = F.col("_mix_epoch")
    new = (e, hashed(target.seed, "order", e, F.col("_mix_source"), F.col("_mix_block")), hashed(target.seed, "slot", e, F.col(key)))
    return out.select(*(F.col(c) for c in docs.columns if c not in place), *(c.alias(name) for c, name in zip(new, place, strict=True)))


def in_order(mixed: DataFrame, place: tuple[str, str, str] = PLACE) -> DataFrame:
    """The rows of a mixture in the order of its epochs, blocks and slots, dealt out by ranges of blocks."""
    return mixed.repartitionByRange(*place[:2]).sortWithinPartitions(*place)
