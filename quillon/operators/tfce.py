"""Threshold-free cluster enhancement of statistic maps over a graph.

The kernel builds the tree of components of the superlevel sets by joining edges in falling order of the lower of their two values. A tree
node stands for a component of constant size between two heights, so whatever the weighting, its share is size^E times the weight between
the heights: an integral, or a running sum over the thresholds in between. A graph node's value is the sum of the shares on its way to
the root, taken for all nodes at once by pointer doubling.

Maps are rows (map_id, node, stat); each map is one task's work, the graph is broadcast after a check of its size. ``tfce_naive`` does the same
with DataFrame joins alone, for a given list of bands, at any size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.graph import Domain, NeuroError

#: Edges that are broadcast at most.
LARGEST = 50_000_000


class InvalidParams(NeuroError):
    """Settings outside their range."""


class NonFiniteStat(NeuroError):
    """A statistic that isn't finite."""


class InvalidBands(NeuroError):
    """Thresholds that don't rise, or weights that don't match them."""


class Weighting(Enum):
    SMITH_NICHOLS = "smith_nichols"
    MNE_STEP = "mne"
    FSLMATHS = "fslmaths"
    EXACT = "exact"
    NILEARN = "nilearn"


class Tail(Enum):
    POSITIVE = "positive"
    NEGATIVE = "negative"
    TWO_SIDED = "two_sided"


@dataclass(frozen=True)
class TfceParams:
    """Exponents e and h; start and step of the threshold grid."""

    weighting: Weighting
    e: float = 0.5
    h: float = 2.0
    start: float = 0.0
    step: float = 0.1

    def __post_init__(self) -> None:
        if not all(map(math.isfinite, (self.e, self.h, self.start, self.step))) or self.step <= 0:
            raise InvalidParams("settings must be finite and the step positive")
        if self.start < 0 or self.weighting is Weighting.EXACT and self.h <= -1:
            raise InvalidParams("start must be 0 at least, and the integral needs h > -1")


#: Presets, by name.
PRESETS = {"exact": TfceParams(Weighting.EXACT), "nilearn": TfceParams(Weighting.NILEARN)}
#: What a weighting takes besides e and h, and whether it must be given.
_TAKES = {Weighting.EXACT: {"start": False}, Weighting.NILEARN: {}} | {w: {"start": True, "step": True} for w in (Weighting.MNE_STEP, Weighting.SMITH_NICHOLS, Weighting.FSLMATHS)}
#: Weightings of permutation inference: all but the plain powers of the thresholds.
INFERENCE = frozenset(Weighting) - {Weighting.FSLMATHS}


def resolve_params(params, accepted=frozenset(Weighting)) -> TfceParams:
    """Settings from a preset's name or a dict: weighting, e and h, and the start and step that the weighting takes. Keys that it doesn't take are errors."""
    if isinstance(params, str):
        if params not in PRESETS:
            raise InvalidParams(f"params must be settings or one of {sorted(PRESETS)}")
        params = PRESETS[params]
    if isinstance(params, dict):
        try:
            weighting = Weighting(params["weighting"])
        except (KeyError, ValueError):
            raise InvalidParams(f"weighting must be one of {sorted(w.value for w in accepted)}") from None
        takes, given = _TAKES[weighting], set(params) - {"weighting", "e", "h"}
        if given - set(takes) or any(needed and k not in given for k, needed in takes.items()):
            raise InvalidParams(f"{weighting.value} takes e, h and {sorted(takes)}, and needs {sorted(k for k, needed in takes.items() if needed)}")
        try:
            params = TfceParams(weighting, **{k: float(v) for k, v in params.items() if k != "weighting"})
        except (TypeError, ValueError) as wrong:
            raise InvalidParams(f"settings must be finite numbers: {wrong}") from None
    if not isinstance(params, TfceParams) or params.weighting not in accepted:
        raise InvalidParams(f"params must be settings of one of {sorted(w.value for w in accepted)}")
    return params


def grid(params: TfceParams, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds and weights of a grid weighting for maps whose greatest value is top."""
    if params.weighting is Weighting.EXACT:
        raise InvalidParams("the exact weighting has no grid")
    if params.weighting is Weighting.NILEARN:
        if not top / 100 >= np.finfo(float).tiny:
            return np.zeros(0), np.zeros(0)
        h = np.linspace(0, top, 101)[1:]
        return h, h**params.h
    h = np.arange(params.start, top, params.step) if top > params.start else np.zeros(0)
    if params.weighting is Weighting.SMITH_NICHOLS:
        return h, h**params.h * params.step
    if params.weighting is Weighting.FSLMATHS:
        return h, h**params.h
    return h, np.abs(np.diff(h, prepend=0.0)) ** params.h


def check_bands(thresholds, weights, e: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising, finite thresholds, with as many finite weights."""
    h, w = np.asarray(thresholds, float), np.asarray(weights, float)
    if not math.isfinite(e):
        raise InvalidParams("e must be finite")
    if h.shape != w.shape or not (np.isfinite(h).all() and np.isfinite(w).all()) or (np.diff(h) <= 0).any():
        raise InvalidBands("thresholds must rise and match the weights")
    return h, w


def _forest(domain: Domain, stat: np.ndarray, active: np.ndarray):
    """The component tree: parent, height and size of its nodes; the first are the graph's active nodes."""
    both = active[domain.src] & active[domain.dst]
    u, v = domain.src[both], domain.dst[both]
    number = np.cumsum(active) - 1
    height = stat[active]
    low = np.minimum(stat[u], stat[v])
    order = np.argsort(-low, kind="stable")
    n = len(height)
    root = list(range(n))  # of the disjoint sets
    top = list(range(n))  # the tree node that stands for a set
    count = [1] * n
    parent, heights, sizes = [-1] * n, height.tolist(), [1] * n
    for a, b, h in zip(number[u[order]].tolist(), number[v[order]].tolist(), low[order].tolist(), strict=True):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a == b:
            continue
        if count[a] < count[b]:
            a, b = b, a
        new = len(parent)
        parent[top[a]] = parent[top[b]] = new
        parent.append(-1)
        root[b] = a
        count[a] += count[b]
        heights.append(h)
        sizes.append(count[a])
        top[a] = new
    return np.array(parent, np.int64), np.array(heights), np.array(sizes, float)


def enhance(domain: Domain, stat: np.ndarray, active: np.ndarray, weight_below, e: float) -> np.ndarray:
    """weight_below(h): the weight of all that a component at height h counts for; 0 where nothing is below."""
    out = np.zeros(len(stat))
    if not active.any():
        return out
    parent, height, size = _forest(domain, stat, active)
    below = weight_below(height)
    share = size**e * (below - np.where(parent >= 0, below[parent], 0.0))
    jump = np.where(parent >= 0, parent, len(parent))
    share, jump = np.append(share, 0.0), np.append(jump, len(parent))
    while (jump[:-1] != len(parent)).any():
        share = share + share[jump]
        jump = jump[jump]
    out[active] = share[: int(active.sum())]
    return out


def _found(root: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The roots of some nodes of disjoint sets; the ways there are shortened."""
    now = root[at]
    while True:
        above = root[now]
        if np.array_equal(above, now):
            break
        now = above
    root[at] = now
    return now


def enhance_levels(src: np.ndarray, dst: np.ndarray, level: np.ndarray, weight: np.ndarray, e: float) -> np.ndarray:
    """Enhancement by bands, where level is the number of bands that a node belongs to.

    weight[l]: the weight of the first l bands. Bands are taken from the highest down; in each, the edges that come in join components in numpy rounds, and a changed component gets a new tree node. A node's value is the sum of the
    shares on its way to the root, taken band by band from the root's side.
    """
    n = len(level)
    low = np.minimum(level[src], level[dst])
    edges = np.flatnonzero(low)
    low = low[edges]
    edges = edges[np.argsort(-low.astype(np.int32), kind="stable")]
    top = int(level.max(initial=0))
    cut = np.searchsorted(-np.minimum(level[src[edges]], level[dst[edges]]).astype(np.int32), -np.arange(top, -1, -1), "left")
    root, size, node = np.arange(n), np.ones(n), np.arange(n)
    sizes, levels, bounds = [], [], []
    parent = np.full(2 * n, -1)
    count = n
    for k in range(top):  # band top - k
        here = edges[cut[k] : cut[k + 1]]
        a, b = _found(root, src[here]), _found(root, dst[here])
        apart = a != b
        if apart.any():
            a, b = a[apart], b[apart]
            old = np.unique(np.concatenate((a, b)))
            while len(a):
                root[np.maximum(a, b)] = np.minimum(a, b)
                a, b = _found(root, a), _found(root, b)
                apart = a != b
                a, b = a[apart], b[apart]
            now = _found(root, old)
            new, at = np.unique(now, return_inverse=True)
            ids = count + np.arange(len(new))
            parent[node[old]] = ids[at]
            total = np.bincount(at, size[old])
            node[new], size[new] = ids, total
            sizes.append(total)
            levels.append(np.full(len(new), top - k))
            bounds.append((count, count + len(new)))
            count += len(new)
    parent = parent[:count]
    size = np.concatenate((np.ones(n), *sizes))
    height = np.concatenate((level, *levels)).astype(np.int64)
    below = weight[height]
    share = size**e * (below - np.where(parent >= 0, below[parent], 0.0))
    for lo, hi in reversed(bounds):
        up = parent[lo:hi]
        share[lo:hi] += np.where(up >= 0, share[up], 0.0)
    return share[:n] + np.where(parent[:n] >= 0, share[parent[:n]], 0.0)


def _one_tail(domain: Domain, stat: np.ndarray, params: TfceParams, top: float) -> np.ndarray:
    if params.weighting is Weighting.EXACT:
        k = params.h + 1
        return enhance(domain, stat, stat > params.start, lambda h: (h**k - params.start**k) / k, params.e)
    h, w = grid(params, top)
    return bands(domain, stat, h, w, params.e, params.weighting is not Weighting.NILEARN)


def bands(domain: Domain, stat: np.ndarray, thresholds: np.ndarray, weights: np.ndarray, e: float, strict: bool = True) -> np.ndarray:
    """Enhancement by a given list of bands; membership is stat > h, or stat >= h."""
    if not len(thresholds):
        return np.zeros(len(stat))
    total = np.concatenate(([0.0], np.cumsum(weights)))
    return enhance_levels(domain.src, domain.dst, np.searchsorted(thresholds, stat, "left" if strict else "right"), total, e)


def tfce_map(domain: Domain, stat: np.ndarray, params: TfceParams, tail: Tail = Tail.POSITIVE) -> np.ndarray:
    """The enhanced map of one statistic map. Two-sided maps share one grid, from the greatest absolute value."""
    stat = np.asarray(stat, float)
    if len(stat) != domain.n:
        raise NeuroError(f"needs {domain.n} values, got {len(stat)}")
    if not np.isfinite(stat).all():
        raise NonFiniteStat("statistics must be finite")
    if not len(stat):
        return stat
    if tail is Tail.POSITIVE:
        return _one_tail(domain, stat, params, float(stat.max()))
    if tail is Tail.NEGATIVE:
        return _one_tail(domain, -stat, params, float(-stat.min()))
    top = float(np.abs(stat).max())
    return _one_tail(domain, stat, params, top) - _one_tail(domain, -stat, params, top)


def checked_broadcast(spark, domain: Domain):
    """The graph for every executor, refused beyond LARGEST edges."""
    if len(domain.src) > LARGEST:
        raise NeuroError(f"a graph of more than {LARGEST} edges isn't broadcast; tfce_naive takes any size")
    return spark.sparkContext.broadcast(domain)


def tfce(maps: DataFrame, domain: Domain, params="exact", tail: Tail = Tail.TWO_SIDED) -> DataFrame:
    """(map_id, node, tfce) of maps (map_id, node, stat); every node of the graph must have a value in every map."""
    params = resolve_params(params)
    shared = checked_broadcast(maps.sparkSession, domain)

    def run(t: pa.Table) -> pa.Table:
        own = shared.value
        node, stat = t.column("node").to_numpy(), t.column("stat").to_numpy()
        values = np.full(own.n, np.nan)
        values[node] = stat
        out = tfce_map(own, values, params, tail)
        return pa.table({"map_id": pa.array(np.full(own.n, t.column("map_id")[0].as_py())), "node": pa.array(np.arange(own.n)), "tfce": pa.array(out)})

    ready = maps.select(F.col("map_id").cast("long").alias("map_id"), F.col("node").cast("long").alias("node"), F.col("stat").cast("double").alias("stat"))
    return ready.groupBy("map_id").applyInArrow(run, "map_id long, node long, tfce double")


def tfce_bands(maps: DataFrame, domain: Domain, thresholds, weights, e: float, strict: bool = True) -> DataFrame:
    """The same by given bands."""
    h, w = check_bands(thresholds, weights, e)
    shared = checked_broadcast(maps.sparkSession, domain)

    def run(t: pa.Table) -> pa.Table:
        own = shared.value
        values = np.full(own.n, np.nan)
        values[t.column("node").to_numpy()] = t.column("stat").to_numpy()
        return pa.table({"map_id": pa.array(np.full(own.n, t.column("map_id")[0].as_py())), "node": pa.array(np.arange(own.n)), "tfce": pa.array(bands(own, values, h, w, e, strict))})

    ready = maps.select(F.col("map_id").cast("long").alias("map_id"), F.col("node").cast("long").alias("node"), F.col("stat").cast("double").alias("stat"))
    return ready.groupBy("map_id").applyInArrow(run, "map_id long, node long, tfce double")


def tfce_naive(maps: DataFrame, edges: DataFrame, thresholds, weights, e: float, strict: bool = True, most: int = 200) -> DataFrame:
    """(map_id, node, tfce) by DataFrame operations alone: in every band, least labels spread along the edges until they rest."""
    h, w = check_bands(thresholds, weights, e)
    spark = maps.sparkSession
    levels = F.array(*(F.struct(F.lit(i).alias("band"), F.lit(float(a)).alias("h"), F.lit(float(b)).alias("w")) for i, (a, b) in enumerate(zip(h, w, strict=True))))
    inside = (F.col("stat") > F.col("l.h")) if strict else (F.col("stat") >= F.col("l.h"))
    members = maps.withColumn("l", F.explode(levels)).where(inside).select("map_id", F.col("l.band").alias("band"), F.col("l.w").alias("w"), "node", F.col("node").alias("label")).checkpoint()
    keys = ["map_id", "band"]
    links = members.select(*keys, F.col("node").alias("src")).join(edges, "src").join(members.select(*keys, F.col("node").alias("dst")), [*keys, "dst"]).select(*keys, "src", "dst").checkpoint()
    now = members
    for _ in range(most):
        near = links.join(now.select(*keys, F.col("node").alias("dst"), "label"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node")).agg(F.min("label").alias("near"))
        # the label's own label, so that chains halve
        hop = now.select(*keys, F.col("node").alias("label"), F.col("label").alias("hop"))
        nxt = now.join(near, [*keys, "node"], "left").join(hop, [*keys, "label"]).select(*keys, "w", "node", F.least("label", "hop", F.coalesce("near", "label")).alias("label"), (F.least("label", "hop", F.coalesce("near", "label")) < F.col("label")).alias("moved")).checkpoint()
        now = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("labels did not settle")
    sizes = now.groupBy(*keys, "label").agg(F.count("*").alias("size"))
    summed = now.join(sizes, [*keys, "label"]).groupBy("map_id", "node").agg(F.sum(F.pow(F.col("size").cast("double"), F.lit(float(e))) * F.col("w")).alias("tfce"))
    return maps.select("map_id", "node").join(summed, ["map_id", "node"], "left").select("map_id", "node", F.coalesce("tfce", F.lit(0.0)).alias("tfce"))
