"""Quality of texts: random-indexing word vectors, pooled for each text, and a small network.

A text is a row of words: runs of letters and digits in lower case, runs of other signs, and after each of them a word for its shape (capitals, first capital, digits, signs, a run of one sign, or
that it equals the word before). Every word has a sparse index vector of +1 and -1, made from its hash. A word's context vector is the sum of the index vectors of
the words up to WINDOW places away, shifted by the distance, over all texts (random indexing). Words share VOCABULARY rows by hash, so the table has one size at any number of words, and no word
is left out. Word vectors are context and index vector of unit length each, less the mean of all words.

A text is pooled into the mean and the standard deviation of its words' vectors and its log length. A network of two layers (tanh, logistic), in numpy, is trained on
the pooled texts of labelled rows; a last part of them, unseen in training, gives the temperature that divides its logits.

Bounds: at most PER_CLASS labelled rows of each label, drawn by the hash of the id; each task and the driver hold VOCABULARY x WIDTH sums, of which a task emits the
rows it has met. Context vectors take one pass over all texts, scoring another; texts are never shuffled.

Defined results: a null or empty text is pooled to zeros and gets the network's value for that; without labelled rows every score is 0.5, with rows of one label only it is that
label; several labels of one id count as the least; of labelled rows with one id and several texts, the greatest pooled one counts; repeated rows give repeated results; an empty table
gives no rows; only the id and the text are read in scoring, columns to keep may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_sample

PER_CLASS = 4000
#: Rows and columns of the table of word vectors.
VOCABULARY, WIDTH = 8192, 64
#: Places of an index vector that aren't zero.
PLACES = 4
WINDOW = 2
#: Columns of a context vector are shifted by this for each place of distance.
SHIFT = 17
HIDDEN = 24
CACHE = 200_000
#: Words that are counted at once.
AT_ONCE = 1 << 19
_WORDS = re.compile(r"[^\W_]+|[^\w\s]+|_+")
#: Names of the shapes; the last is a word that equals the one before.
SHAPES = ("\0lower", "\0upper", "\0title", "\0mixed", "\0digit", "\0sign", "\0signs", "\0same")
_SAME = len(SHAPES) - 1


def bucket(word: str) -> int:
    """The row of a word."""
    return xxhash.xxh32_intdigest(word.encode()) % VOCABULARY


_SHAPE_ROWS = np.array([bucket(s) for s in SHAPES], np.int64)


def shape(word: str) -> int:
    """The number of a word's shape."""
    if word.isalpha():
        if word.islower():
            return 0
        if word.isupper():
            return 1 if len(word) > 1 else 2
        return 2 if word[:1].isupper() and word[1:].islower() else 3
    if word.isdigit():
        return 4
    if word.isalnum():
        return 3
    return 6 if len(word) > 1 and len(set(word)) == 1 else 5


def _packed(word: str) -> int:
    return bucket(word.lower()) | shape(word) << 32


class Reader:
    """Turns texts into rows of word numbers; keeps the numbers of words it has met."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def ids(self, text: str | None) -> np.ndarray:
        """Word and shape numbers, by turns."""
        found = _WORDS.findall(text) if text else []
        got = list(map(self.seen.get, found))
        if None in got:
            if len(self.seen) > CACHE:
                self.seen.clear()
                got = [None] * len(found)
            for w, x in zip(found, got, strict=True):
                if x is None and w not in self.seen:
                    self.seen[w] = _packed(w)
            got = list(map(self.seen.__getitem__, found))
        p = np.array(got, np.int64)
        out = np.empty(2 * len(p), np.int64)
        word, form = p & 0xFFFFFFFF, p >> 32
        form[1:][word[1:] == word[:-1]] = _SAME
        out[0::2], out[1::2] = word, _SHAPE_ROWS[form]
        return out


def index_vectors(seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (PLACES of each) of every row's index vector."""
    r = np.random.Generator(np.random.PCG64(seed))
    places = np.argsort(r.random((VOCABULARY, WIDTH)), axis=1)[:, :PLACES]
    return places, r.integers(0, 2, places.shape) * 2 - 1


def contexts(rows: list[np.ndarray], places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sums of context vectors of some texts' words: [VOCABULARY, WIDTH]; neighbours of another text don't count."""
    gap = np.full(WINDOW, -1, np.int64)
    ids = np.concatenate([x for r in rows for x in (r, gap)])
    total = np.zeros(VOCABULARY * WIDTH)
    for away in range(1, WINDOW + 1):
        a, b = ids[:-away], ids[away:]
        both = (a >= 0) & (b >= 0)
        a, b = a[both], b[both]
        for word, near, shift in ((a, b, SHIFT * away), (b, a, -SHIFT * away)):
            base = word * WIDTH
            for k in range(PLACES):
                total += np.bincount(base + (places[near, k] + shift) % WIDTH, signs[near, k], len(total))
    return total.reshape(VOCABULARY, WIDTH)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task: a row for each row of the table that it has met."""
    reader, (places, signs) = Reader(), index_vectors()
    total, count = np.zeros((VOCABULARY, WIDTH)), np.zeros(VOCABULARY, np.int64)
    waiting, size = [], 0

    def flush():
        nonlocal waiting, size, total
        if size:
            total += contexts(waiting, places, signs)
        waiting, size = [], 0

    for b in batches:
        for t in b.column(0):
            r = reader.ids(t.as_py())
            count += np.bincount(r, minlength=VOCABULARY) if len(r) > 4096 else 0
            if 0 < len(r) <= 4096:
                np.add.at(count, r, 1)
            waiting.append(r)
            size += len(r)
            if size >= AT_ONCE:
                flush()
    flush()
    met = np.flatnonzero(count)
    whole = total[met].astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), *(pa.array(whole[:, k]) for k in range(WIDTH))], ["word", "n", *(f"d{k}" for k in range(WIDTH))])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The table of word vectors of all texts."""
    sums = docs.select(F.col(text).alias("_text")).mapInArrow(_counted, ", ".join(["word long, n long", *(f"d{k} long" for k in range(WIDTH))]))
    got = sums.groupBy("word").agg(F.sum("n").alias("n"), *(F.sum(f"d{k}").alias(f"d{k}") for k in range(WIDTH))).toArrow()  # at most VOCABULARY rows
    return finished(got.column("word").to_numpy(), got.column("n").to_numpy(), np.column_stack([got.column(f"d{k}").to_numpy() for k in range(WIDTH)]) if got.num_rows else np.zeros((0, WIDTH)))


def finished(words: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Word vectors from sums of context vectors."""
    places, signs = index_vectors()
    out = np.zeros((VOCABULARY, WIDTH))
    np.put_along_axis(out, places, signs / PLACES**0.5, 1)
    x = sums.astype(float)
    out[words] += x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    mean = (counts[:, None] * out[words]).sum(0) / counts.sum() if len(words) else 0.0
    return (out - mean).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the words' vectors, and the log length."""
    if not len(ids):
        return np.zeros(2 * WIDTH + 1)
    kinds, n = np.unique(ids, return_counts=True)
    x, w = vectors[kinds].astype(float), n / len(ids)
    mean = w @ x
    return np.concatenate((mean, np.sqrt(np.maximum(w @ (x * x) - mean * mean, 0)), [np.log1p(len(ids)) / 10]))


class Network:
    """Standardised inputs, a tanh layer and a logistic one; temperature divides the logits."""

    def __init__(self, width: int, hidden: int = HIDDEN, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.middle, self.spread, self.temperature, self.constant = np.zeros(width), np.ones(width), 1.0, None
        self.w = [r.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        return np.tanh(np.clip((x - self.middle) / self.spread, -8, 8) @ a + b) @ c + d[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400, rate: float = 0.01, ridge: float = 1e-3) -> None:
        """Adam over all rows."""
        weight = weight / weight.sum()
        self.middle = weight @ x
        self.spread = np.sqrt(weight @ (x - self.middle) ** 2) + 1e-6
        z = np.clip((x - self.middle) / self.spread, -8, 8)
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for t in range(1, rounds + 1):
            h = np.tanh(z @ self.w[0] + self.w[1])
            p = 1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3][0], -30, 30)))
            g = weight * (p - y)
            back = np.outer(g, self.w[2]) * (1 - h * h)
            grads = [z.T @ back + ridge * self.w[0], back.sum(0), h.T @ g + ridge * self.w[2], np.array([g.sum()])]
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature with the least log loss, by golden section over its logarithm. Targets are drawn in by a row of each label, so that separable rows don't make it 0."""
        z = self.logits(x)
        n = int(y.sum())
        target = np.where(y == 1, (n + 1) / (n + 2), 1 / (len(y) - n + 2))

        def loss(t: float) -> float:
            s = z / np.exp(t)
            return float((weight * (target * np.logaddexp(0, -s) + (1 - target) * np.logaddexp(0, s))).sum())

        a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(60):
            c, d = b - g * (b - a), a + g * (b - a)
            a, b = (a, d) if loss(c) < loss(d) else (c, b)
        self.temperature = float(np.exp((a + b) / 2))


class Model:
    """Word vectors and the network; sent to the executors."""

    def __init__(self, vectors: np.ndarray, network: Network) -> None:
        self.vectors, self.network, self.reader = vectors, network, Reader()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"reader": Reader()}

    def features(self, text: str | None) -> np.ndarray:
        """The pooled vector of a text."""
        return pooled(self.reader.ids(text), self.vectors)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """The score of each text."""
        x = [self.features(t) for t in texts]
        return self.network.probability(np.array(x)) if x else np.zeros(0)


def _sampled(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, per_class: int) -> list[tuple]:
    """(id, label, pooled text, rows of this label) of the labelled sample, in order."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    counts = F.broadcast(known.groupBy("label").agg(F.count("*").alias("n")))  # two labels
    chosen = bounded_sample(known, "label", per_class).join(counts, "label")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 x per_class ids
    model = docs.sparkSession.sparkContext.broadcast(Model(vectors, Network(2 * WIDTH + 1)))

    def run(batches):
        for b in batches:
            x = [model.value.features(t.as_py()).tolist() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "n", "x"])

    made = rows.select(F.col("doc_id").cast("long"), "label", "n", "text").mapInArrow(run, "doc_id long, label int, n long, x array<double>")
    one = made.groupBy("doc_id", "label", "n").agg(F.max("x").alias("x"))  # one row for an id, however often it is repeated
    return sorted(tuple(r) for r in one.collect())  # at most 2 x per_class rows


def fit(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, per_class: int = PER_CLASS) -> Model:
    """Learn from labelled rows. docs: doc_id, text; labels: doc_id, quality; give only rows that may be learned from. corpus: the texts of the word vectors, docs if none.

    A quarter of the sample gives the temperature. Labels weigh as in the whole table, not as in the sample.
    """
    vectors = word_vectors(docs if corpus is None else corpus)
    sample = _sampled(docs, labels, vectors, per_class)
    net = Network(2 * WIDTH + 1)
    y = np.array([s[1] for s in sample], float)
    if len(set(y.tolist())) < 2:
        net.constant = float(y[0]) if len(y) else 0.5
        return Model(vectors, net)
    x = np.array([s[3] for s in sample])
    sizes = {k: int((y == k).sum()) for k in (0, 1)}
    weight = np.array([s[2] / sizes[s[1]] for s in sample])
    last = np.array([xxhash.xxh32_intdigest(f"temperature {s[0]}") % 4 == 0 for s in sample])
    if len(set(y[last].tolist())) < 2 or len(set(y[~last].tolist())) < 2:  # too few to part
        last = np.ones(len(y), bool)
        net.train(x, y, weight)
    else:
        net.train(x[~last], y[~last], weight[~last])
    net.calibrate(x[last], y[last], weight[last])
    return Model(vectors, net)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns to keep, and the score (0 to 1) of every row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ready = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text).alias("_text"))
    kinds = "".join(f"_k{i} {ready.schema[f'_k{i}'].dataType.simpleString()}, " for i in range(len(keep)))

    def run(batches):
        for b in batches:
            s = shared.value.scores(t.as_py() for t in b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s, pa.float64())], [*(f"_k{i}" for i in range(len(keep))), "score"])

    done = ready.mapInArrow(run, f"{kinds}score double")
    return done.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "score")
