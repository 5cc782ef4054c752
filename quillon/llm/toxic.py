"""Toxic passages by maximum-scoring segments.

Words get log-odds of standing in toxic text, from the numbers of texts that hold them, with Dirichlet priors in levels: the rate of a word is drawn towards that of its first five letters, that
towards the first four, the first three and at last the base rate; each level adds STRENGTH pseudo-counts. A word that wasn't seen has the log-odds of its
longest known beginning, or 0. All are lowered by DRIFT, so that ordinary text drifts down. A linear scan finds all maximal scoring segments of a text (Ruzzo and Tompa). Their
significance is that of extreme values: E = K n exp(-lambda S) for a text of n words, where lambda solves
sum p(s) exp(lambda s) = 1 over the scores of non-toxic text and K is fitted to the best segments of non-toxic texts. A logistic
curve over -ln E of the best segment and the sum over significant segments gives the probability of the label.

Bounds: the scores are learned from at most PER_CLASS labelled rows of each label, drawn by the hash of the id, and the curve from as many
others; all their words are kept. The words are counted and rated in Spark; the driver and the tasks hold 16 bytes a word. Scoring is one map over the texts, without a shuffle.

Defined results: a null or empty text has no segment and gets the curve's value for that; without labelled rows of both classes every score
is 1 / (1 + exp(30)), next to 0; several labels of one id count as toxic if one is; of several texts of a labelled id the greatest is learned from; repeated rows give repeated results; an empty table gives no rows; only the id
and the text are read in scoring, so clashing extra columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, bounded_sample, stored

PER_CLASS = 4000
STRENGTH = 5.0
#: Taken off the log-odds of every word.
DRIFT = 1.0
#: Beginnings of words, from short to long.
LEVELS = (3, 4, 5)
SIGNIFICANT = 0.05
#: Bound of lambda, for backgrounds without a positive score.
STEEPEST = 64.0
CACHE = 200_000
_WORDS = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """The lower-case words of a text."""
    return _WORDS.findall(text.lower()) if text else []


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order; end is exclusive. Linear time (Ruzzo and Tompa, 1999)."""
    hot = np.flatnonzero(scores > 0)
    if not len(hot):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    # candidates: start, end, total before and after, and the last earlier candidate with a smaller total before
    start, end, low, high, link = [], [], [], [], []
    for i, a, b in zip(hot.tolist(), total[hot].tolist(), total[hot + 1].tolist(), strict=True):
        s, j = i, len(start) - 1
        while True:
            while j >= 0 and low[j] >= a:
                j = link[j]
            if j < 0 or high[j] >= b:
                break
            s, a, back = start[j], low[j], link[j]
            del start[j:], end[j:], low[j:], high[j:], link[j:]
            j = back
        start.append(s)
        end.append(i + 1)
        low.append(a)
        high.append(b)
        link.append(j)
    return [(s, e, b - a) for s, e, a, b in zip(start, end, low, high, strict=True)]


def karlin(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1, by bisection; infinite where no score is positive."""
    p = weights / weights.sum()
    if not (values[p > 0] > 0).any():
        return math.inf
    f = lambda x: float((p * np.exp(np.minimum(x * values, 600))).sum()) - 1
    if float((p * values).sum()) >= 0:
        return 1e-3  # the background doesn't drift down: nothing is significant
    hi = 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    lo = 0.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def rates(counts: DataFrame, base: float) -> DataFrame:
    """Rows (key, rate, other): the hash and rate of every word, and of beginnings (with * at the end). other: non-toxic texts with the word, 0 for beginnings.

    Takes words with their numbers of texts (word, toxic, other). LEVELS are consecutive, so the first characters of a word, or of a
    beginning, up to the last level below it name its parent.
    """
    rate = lambda parent: (F.col("toxic") + F.lit(STRENGTH) * parent) / (F.col("toxic") + F.col("other") + F.lit(STRENGTH))
    begins = None
    for n in LEVELS:
        own = counts.where(F.length("word") >= n).groupBy(F.substring("word", 1, n).alias("stem")).agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        if begins is None:
            begins = above = own.select("stem", rate(F.lit(base)).alias("rate"))
        else:
            up = above.select(F.col("stem").alias("up"), F.col("rate").alias("parent"))
            above = own.join(up, F.substring("stem", 1, n - 1) == F.col("up")).select("stem", rate(F.col("parent")).alias("rate"))
            begins = begins.union(above)
    up = begins.select(F.col("stem").alias("up"), F.col("rate").alias("parent"))
    each = counts.join(up, F.substring("word", 1, LEVELS[-1]) == F.col("up"), "left")
    return each.select(F.xxhash64("word").alias("key"), rate(F.coalesce("parent", F.lit(base))).alias("rate"), "other").union(
        begins.select(F.xxhash64(F.concat("stem", F.lit("*"))), "rate", F.lit(0).cast("long"))
    )


class Odds:
    """Scores of words and beginnings by the hash of the key, in order: 16 bytes a key."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.scores = keys[order], scores[order]

    def of(self, keys: list[str]) -> np.ndarray:
        """The scores of keys, NaN where unknown."""
        if not len(self.keys):
            return np.full(len(keys), np.nan)
        h = np.fromiter((xxhash.xxh64_intdigest(k.encode(), 42) for k in keys), np.uint64, len(keys)).view(np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.scores[at], np.nan)

    def get(self, key: str, default: float | None = None) -> float | None:
        """The score of one key."""
        s = float(self.of([key])[0])
        return default if math.isnan(s) else s

    def __contains__(self, key: str) -> bool:
        return self.get(key) is not None

    def __getitem__(self, key: str) -> float:
        s = self.get(key)
        if s is None:
            raise KeyError(key)
        return s


class Model:
    """Word scores and the calibration; a plain object that is sent to the executors."""

    def __init__(self, odds: Odds) -> None:
        self.odds, self.rate, self.k, self.curve = odds, 1.0, 1.0, np.array([-10.0, 0.0, 0.0])
        self.seen: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def look_up(self, found: list[str]) -> list[float]:
        """The scores of words: their own, or those of their longest known beginnings."""
        s = self.odds.of(found)
        for level in reversed(LEVELS):
            open_ = [i for i in np.flatnonzero(np.isnan(s)).tolist() if len(found[i]) >= level]
            s[open_] = self.odds.of([f"{found[i][:level]}*" for i in open_])
        return np.where(np.isnan(s), -DRIFT, s).tolist()

    def scored(self, text: str | None) -> np.ndarray:
        """The scores of the words of a text."""
        found = words(text)
        got = list(map(self.seen.get, found))
        if None in got:
            if len(self.seen) > CACHE:
                self.seen.clear()
                got = [None] * len(found)
            new = list({w for w, x in zip(found, got, strict=True) if x is None})
            self.seen.update(zip(new, self.look_up(new), strict=True))
            got = list(map(self.seen.get, found))
        return np.array(got, float)

    def surprise(self, s: float, n: int) -> float:
        """-ln E of a segment in a text of n words."""
        return self.rate * s - math.log(self.k * max(n, 1))

    def features(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], np.ndarray]:
        """Significant segments (start word, end word, score, E) and what the curve takes."""
        x = self.scored(text)
        found = [(a, b, s, self.surprise(s, len(x))) for a, b, s in segments(x)]
        best = max((v for *_, v in found), default=-10.0)
        sig = [(a, b, s, math.exp(-v)) for a, b, s, v in found if v >= -math.log(SIGNIFICANT)]
        return sig, np.array([1.0, max(min(best, 50.0), -10.0), math.log1p(sum(min(self.rate * s, 50.0) for _, _, s, _ in sig))])

    def probability(self, features: np.ndarray) -> float:
        """The curve."""
        return float(1 / (1 + np.exp(-np.clip(features @ self.curve, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _counted(batches):
    """In how many texts of each label a word stands, summed within a batch."""
    for b in batches:
        found = {0: Counter(), 1: Counter()}
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found[label].update(set(words(text)))
        rows = [(label, w, n) for label, c in found.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.int64()))], ["label", "word", "n"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from labelled rows. docs: doc_id, text; labels: doc_id, toxic; give only rows that may be learned from.

    Half of the sample gives the word scores, the other half the calibration.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = bounded_sample(known, "label", 2 * per_class).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 4 x per_class ids
    sample = sample.groupBy("doc_id", "label", "half").agg(F.max("text").alias("text"))  # one row for an id, however often it is repeated
    with Scratch(docs.sparkSession):
        return _learned(stored(sample.select("label", "half", "text")))


def _learned(sample: DataFrame) -> Model:
    """The model of a stored sample: label, half, text."""
    spark = sample.sparkSession
    each = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0))
    found = sample.where("half = 0").select("label", "text").mapInArrow(_counted, "label int, word string, n long")
    counts = stored(found.groupBy("word").agg(each(1).alias("toxic"), each(0).alias("other")))
    n1, n0 = counts.agg(F.sum("toxic"), F.sum("other")).first()
    if not n1 or not n0:
        model = Model(Odds(np.empty(0, np.int64), np.empty(0)))
        model.curve = np.array([-30.0, 0.0, 0.0])
        return model
    base = n1 / (n1 + n0)
    rated = rates(counts, base).toArrow()
    keys, rate, other = (rated.column(i).to_numpy() for i in range(3))
    odds = np.log(rate / (1 - rate)) - math.log(base / (1 - base)) - DRIFT
    model = Model(Odds(keys, odds))
    values, which = np.unique(odds[other > 0], return_inverse=True)
    model.rate = min(karlin(values, np.bincount(which, other[other > 0])), STEEPEST)
    rest = sample.where("half = 1").select("label", "text")

    def mapped(values: Callable[[Model, str | None], tuple]) -> list[tuple]:
        """Label and two numbers of every text of the other half, in order."""
        shared = spark.sparkContext.broadcast(model)

        def run(batches):
            for b in batches:
                rows = [values(shared.value, t.as_py()) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64())], ["label", "a", "b"])

        out = sorted(tuple(r) for r in rest.mapInArrow(run, "label int, a double, b double").collect())  # at most 4 x per_class rows
        shared.destroy()
        return out

    def best(own: Model, text: str | None) -> tuple[int, float]:
        x = own.scored(text)
        return len(x), max((s for *_, s in segments(x)), default=0.0)

    clean = [(n, s) for label, n, s in mapped(best) if label == 0 and n]
    # K by maximum likelihood of the Gumbel law of the best score, lambda given: 1 / K = mean of n exp(-lambda S)
    model.k = 1 / max(1e-12, float(np.mean([n * math.exp(-model.rate * s) for n, s in clean]))) if clean else 1.0
    marked = mapped(lambda own, text: own.features(text)[1][1:].tolist())
    if len({label for label, *_ in marked}) == 2:
        model.curve = _logistic(np.array([[1.0, *x] for _, *x in marked]), np.array([label for label, *_ in marked], float))
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, score, predicted, and every significant passage: first and last word, score and E."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ready = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col("text").alias("_text"))
    kinds = ", ".join(f"_k{i} {ready.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    span = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])

    def run(batches):
        own = shared.value
        for b in batches:
            texts = b.column(len(keep))
            spans, probabilities = [], []
            for t in texts:
                found, x = own.features(t.as_py())
                spans.append([{"first_word": a, "last_word": e - 1, "score": s, "e_value": v} for a, e, s, v in found])
                probabilities.append(own.probability(x))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(probabilities, pa.float64()), pa.array([int(p >= 0.5) for p in probabilities], pa.int32()), pa.array(spans, pa.list_(span))],
                [*(f"_k{i}" for i in range(len(keep))), "score", "predicted", "passages"],
            )

    done = ready.mapInArrow(run, f"{kinds}, score double, predicted int, passages array<struct<first_word: long, last_word: long, score: double, e_value: double>>")
    return done.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "score", "predicted", "passages")
