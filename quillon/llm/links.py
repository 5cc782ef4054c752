"""From buckets of candidates to classes: every link between different items is found, without making rows of all pairs.

1. Each bucket has a leader, its least id. All members are compared with the leader only: as many comparisons as members. The leader's body is copied
   once for SALT_ROWS members, so that the members of a large bucket are dealt over many tasks.
2. Verified links are joined to components by alternating large-star and small-star steps on edge tables.
3. Links may be lacking only between a bucket's minority, the members outside its largest component, and others. While that is much work, the minority elects another
   leader, which is compared with all members that it isn't joined to yet: again as many comparisons as members.
4. What is left is compared: small buckets whole, many in a group; larger ones in blocks of BLOCK items, minority blocks with all blocks that the distances don't rule out: Jaccard distances obey
   the triangle inequality, so of two items within distance t the distances to the leader differ by t at most. A block holds items of one range of
   distances. Each two blocks are one small group, in which all overlaps come from matrix products; one link for two components is enough.

So a bucket of n copies costs n comparisons, no group holds more than two blocks, and two items of a bucket that are linked always end in one
component. All steps are joins and aggregates over tables; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, dealt_join, stored

#: Members of a bucket for each copy of its leader's body.
SALT_ROWS = 2000
#: Items of a block, and features that are multiplied at once.
BLOCK, COLUMNS = 256, 16_384
#: Buckets of so many members are compared whole, about PACK items in a group; so many pairs are compared one by one.
SMALL, PACK, FEW = 64, 128, 4
#: Another leader is elected while the blocks would copy more bodies than this many times the members, and at most ROUNDS times.
SPREAD, ROUNDS = 4, 6


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(id, root) of every node of an undirected edge table (a, b): root is the least id of its component."""
    with Scratch(edges.sparkSession) as scratch:
        return scratch.only(_components(edges, most, scratch))


def _settled(now: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: each v is then the root of its component, as it is less than every u."""
    ends = now.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").agg(F.count("*")).first()[0]


def _components(edges: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    now = scratch.only(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(most):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # a row for each edge at most; rows that stand twice go at the round's end
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.only(small)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def overlaps(row: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """[n, n]: for each two items, sum over common features of sqrt(w w'): at least the sum of the lesser weights, and equal to it for equal weights."""
    order = np.argsort(keys, kind="stable")
    row, keys, root = row[order], keys[order], np.sqrt(weights[order]).astype(np.float32)
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    at = np.cumsum(first) - 1
    shared = np.bincount(at)[at] > 1 if len(keys) else first
    row, at, root = row[shared], at[shared], root[shared]
    at = np.unique(at, return_inverse=True)[1] if len(at) else at
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(at.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(at, (lo, lo + COLUMNS))
        m = np.zeros((n, min(COLUMNS, int(at.max()) + 1 - lo)), np.float32)
        m[row[a:b], at[a:b] - lo] = root[a:b]
        out += m @ m.T
    return out


def _lacking(ids, roots, wanted, row, keys, w, reach: float) -> list[tuple[int, int]]:
    """Of items with features (row, hash, weight) and a matrix of pairs to look at: linked pairs, one for each two roots."""
    n = len(ids)
    total = np.bincount(row, w, n)
    cut = np.searchsorted(row, np.arange(n + 1))
    x, y = np.nonzero(wanted)
    if len(x) > FEW:
        over = overlaps(row, keys, w, n)
        most = (over / np.maximum(total[:, None] + total[None, :] - over, 1e-300))[x, y]
        order = np.argsort(-most, kind="stable")[: int((most >= reach - 1e-4).sum())]
        x, y = x[order], y[order]
    joined, out = set(), []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        pair = (min(roots[a], roots[b]), max(roots[a], roots[b]))
        if pair in joined:
            continue
        p, q = slice(cut[a], cut[a + 1]), slice(cut[b], cut[b + 1])
        _, u, v = np.intersect1d(keys[p], keys[q], assume_unique=True, return_indices=True)
        common = np.minimum(w[p][u], w[q][v]).sum()
        if common / max(total[a] + total[b] - common, 1e-300) >= reach:
            joined.add(pair)
            out.append((int(ids[a]), int(ids[b])))
    return out


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _apart(roots: np.ndarray, far: np.ndarray, within: float) -> np.ndarray:
    """Pairs of different roots that the distances to the leader don't rule out."""
    return (roots[:, None] != roots[None, :]) & (np.abs(far[:, None] - far[None, :]) <= within + 1e-9)


def _within(features, reach: float):
    """Of two blocks of a bucket (id, root, distance, side, body), side 0 and 1, or 2 for a block with itself: links between components that aren't joined yet."""

    def run(t: pa.Table) -> pa.Table:
        ids, roots, far, side = (t.column(c).to_numpy() for c in ("id", "root", "distance", "side"))
        wanted = _apart(roots, far, 1 - reach)
        wanted &= np.triu(np.ones_like(wanted), 1) if (side == 2).any() else (side == 0)[:, None] & (side == 1)[None, :]
        return _edges(_lacking(ids, roots, wanted, *features(t.column("body").combine_chunks()), reach) if wanted.any() else [])

    return run


def _packed(features, reach: float):
    """The same for many whole, small buckets (bucket, id, root, distance, body)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        bucket, ids, roots, far = (t.column(c).to_numpy() for c in ("bucket", "id", "root", "distance"))
        row, keys, w = features(t.column("body").combine_chunks())
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist()
        found = []
        for lo, hi in zip(first, [*first[1:], len(bucket)], strict=True):
            wanted = np.triu(_apart(roots[lo:hi], far[lo:hi], 1 - reach), 1)
            if wanted.any():
                a, b = np.searchsorted(row, (lo, hi))
                found += _lacking(ids[lo:hi], roots[lo:hi], wanted, row[a:b] - lo, keys[a:b], w[a:b], reach)
        return _edges(found)

    return run


def _checked(pairs: DataFrame, bodies: DataFrame, verify) -> DataFrame:
    """(a, b, similarity) of pairs (a, b, n): n is the number of pairs that a may be in. The body of a is copied for every SALT_ROWS of them."""
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    pairs = stored(pairs.groupBy("a", "b").agg(F.max("n").alias("n")).withColumn("salts", salts))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    leads = pairs.groupBy("a").agg(F.max("salts").alias("salts"))
    left = bodies.join(leads, F.col("id") == F.col("a")).select("a", F.col("body").alias("body_a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = bodies.select(F.col("id").alias("b"), F.col("body").alias("body_b"))
    return dealt.join(left, ["a", "salt"]).join(right, "b").select("a", "b", "body_a", "body_b").mapInArrow(verify, "a long, b long, similarity double")


def linked(members: DataFrame, bodies: DataFrame, verify: Callable, features, reach: float) -> DataFrame:
    """(a, b): verified links, among them enough for complete components of all items.

    members: bucket, id; only buckets of two or more ids. bodies: id, body, what the items are compared by. verify: of Arrow batches (a, b, body_a, body_b)
    gives a, b, similarity. features: of an Arrow column of bodies, the distinct features (row, hash, weight), rows in order, hashes rising in a row.
    reach: the least similarity of a link.
    """
    with Scratch(members.sparkSession) as scratch:
        return scratch.keep(_linked(members, bodies, verify, features, reach))


def _linked(members: DataFrame, bodies: DataFrame, verify: Callable, features, reach: float) -> DataFrame:
    within = 1 - reach
    leaders = stored(members.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("n")))
    star = stored(dealt_join(members, leaders, ["bucket"], "n").where("id <> leader"))
    checked = stored(_checked(star.select(F.col("leader").alias("a"), F.col("id").alias("b"), "n"), bodies, verify))
    roots = components(checked.where(F.col("similarity") >= reach).select("a", "b"))
    far = checked.select(F.col("a").alias("leader"), F.col("b").alias("id"), (1 - F.col("similarity")).alias("distance"))
    # buckets in which a member is out of reach of the leader
    open_ = stored(star.join(far, ["leader", "id"]).select("bucket", "id", "distance"))
    wide = open_.groupBy("bucket").agg(F.max("distance").alias("most"), F.count("*").alias("n")).where((F.col("most") > within) & (F.col("n") > 1)).select("bucket", "n")
    spots = stored(dealt_join(open_, stored(wide), ["bucket"], "n"))
    for left in range(ROUNDS, -1, -1):
        placed = stored(spots.join(roots, "id", "left").select("bucket", "id", "distance", F.coalesce("root", "id").alias("root")))
        sizes = stored(placed.groupBy("bucket", "root").agg(F.count("*").alias("k"), F.min(F.struct("id", "distance")).alias("first")))
        # of each bucket: its largest component; and the first member of the largest of the others
        main = sizes.groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("n")).where("parts > 1").select("bucket", F.col("main.root").alias("main"), "n")
        main = stored(main)
        if main.isEmpty():
            return roots.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b"))
        cell = F.floor(F.col("distance") / within).cast("int")
        parted = stored(dealt_join(placed, main, ["bucket"], "n").select("bucket", "id", "distance", "root", "n", (F.col("root") != F.col("main")).alias("minor"), cell.alias("cell")))
        counts = stored(parted.groupBy("bucket", "minor", "cell").agg(F.count("*").alias("k"), F.max("n").alias("n")).withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int")))
        large = counts.where(F.col("n") > SMALL)
        small = large.where("minor").select("bucket", F.col("cell").alias("cell_i"), F.col("k").alias("k_i"), F.col("blocks").alias("blocks_i"))
        other = large.select("bucket", F.col("minor").alias("minor_j"), F.col("cell").alias("cell_j"), F.col("k").alias("k_j"), F.col("blocks").alias("blocks_j"))
        both = small.join(other, "bucket").where("abs(cell_i - cell_j) <= 1 AND (NOT minor_j OR cell_j >= cell_i)")
        work = both.agg(F.sum(F.col("k_i") * F.col("blocks_j") + F.col("k_j") * F.col("blocks_i"))).first()[0] or 0
        rows, few = counts.agg(F.sum("k"), F.sum(F.when(F.col("n") <= SMALL, F.col("k")).otherwise(0))).first()
        if not left or work <= SPREAD * rows:
            break
        elected = sizes.join(main.select("bucket", "main"), "bucket").where("root <> main").groupBy("bucket").agg(F.max_by(F.struct("first", "root"), F.struct("k", "root")).alias("e"))
        elected = stored(elected.select("bucket", F.col("e.first.id").alias("leader"), F.col("e.first.distance").alias("at"), F.col("e.root").alias("own")).join(main.select("bucket", "n"), "bucket"))
        rest = dealt_join(parted.select("bucket", "id", "distance", "root"), elected, ["bucket"], "n").where((F.col("root") != F.col("own")) & (F.abs(F.col("distance") - F.col("at")) <= within + 1e-9))
        again = _checked(rest.select(F.col("leader").alias("a"), F.col("id").alias("b"), "n"), bodies, verify).where(F.col("similarity") >= reach)
        roots = components(roots.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")).unionByName(again.select("a", "b")))

    joined = roots.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b"))
    whole = parted.where(F.col("n") <= SMALL).select("bucket", "id", "root", "distance", F.pmod(F.xxhash64("bucket"), F.lit(max(1, -(-few // PACK)))).alias("pack"))
    found = joined.unionByName(whole.join(bodies.select("id", "body"), "id").groupBy("pack").applyInArrow(_packed(features, reach), "a long, b long"))
    if not work:
        return found
    pairs = both.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks_i") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks_j") - 1)))
    self_ = F.col("minor_j") & (F.col("cell_i") == F.col("cell_j"))
    group = ["bucket", "cell_i", "i", "minor_j", "cell_j", "j"]
    pairs = pairs.where(~self_ | (F.col("j") >= F.col("i"))).withColumn("alone", self_ & (F.col("i") == F.col("j"))).select(*group, "alone")
    one = pairs.select(*group, F.lit(True).alias("minor"), F.col("cell_i").alias("cell"), F.col("i").alias("block"), F.when(F.col("alone"), 2).otherwise(0).alias("side"))
    two = pairs.where("NOT alone").select(*group, F.col("minor_j").alias("minor"), F.col("cell_j").alias("cell"), F.col("j").alias("block"), F.lit(1).alias("side"))
    blocks = large.select("bucket", "minor", "cell", "blocks", "k")
    items = dealt_join(parted.drop("n"), stored(blocks), ["bucket", "minor", "cell"], "k").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = one.unionByName(two).join(items, ["bucket", "minor", "cell", "block"]).select(*group, "side", "id", "root", "distance").join(bodies.select("id", "body"), "id")
    return found.unionByName(dealt.groupBy(*group).applyInArrow(_within(features, reach), "a long, b long"))
