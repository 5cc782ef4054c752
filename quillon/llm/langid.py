"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. The probability of a marked word in a language is the sum over
all its segmentations into pieces, by a forward pass; a text's is the product over its words and the prior of the language. Piece
probabilities are learned by expectation maximisation (forward-backward over the words) from a bounded sample of labelled rows.

Bounds: per_language rows of each language, drawn by the hash of their id; at most MAX_LANGUAGES languages, so the model that is broadcast
holds at most MAX_LANGUAGES x vocabulary numbers. Priors count all labelled rows. Prediction is one map over the texts, without a shuffle;
words are scored once for each cache of a worker, which is bounded by CACHE words. Words of over LONG characters are summed one by one, in logarithms, so
that any length stays within doubles; they aren't kept.

Defined results: "und" and score 0 for a text that is null or has no letter (or where no labelled row was given); very long words are scored whole; equal likelihoods go to the language that sorts first; repeated rows give repeated results; an
empty table gives no rows; columns other than the id and the text are never read in a prediction.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_sample

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
PER_LANGUAGE = 384
MAX_LANGUAGES = 256
CACHE = 400_000
LONG = 40
ROUNDS = 3
#: Probabilities are scaled by this much for each character, so that words of LONG characters stay within doubles.
GAIN = 24.0
_WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """The lower-case runs of letters of a text, marked."""
    return [MARK + w for w in _WORDS.findall(text.lower())] if text else []


def edges(word: str, start: int, vocabulary: dict[str, int], unknown: int):
    """(end, piece) of all pieces of a word that begin at a place; a character that is no piece is unknown."""
    for end in range(start + 1, len(word) + 1):
        p = vocabulary.get(word[start:end])
        if p is None:
            if end == start + 1:
                yield end, unknown
            return
        if p >= 0 or end == start + 1:
            yield end, p if p >= 0 else unknown


def long_forward(word: str, vocabulary: dict[str, int], unknown: int, ln_p: np.ndarray) -> np.ndarray:
    """ln of the sum over the segmentations of the first characters, for every place: [place, language]. ln_p: [piece, language]."""
    out = np.full((len(word) + 1, ln_p.shape[1]), -np.inf)
    out[0] = 0
    for s in range(len(word)):
        for e, p in edges(word, s, vocabulary, unknown):
            out[e] = np.logaddexp(out[e], out[s] + ln_p[p])
    return out


def long_expected(word: str, vocabulary: dict[str, int], unknown: int, p: np.ndarray, weight: float, used: np.ndarray) -> None:
    """Add to used how often each piece is used, over all segmentations of a long word, in one language."""
    ln_p = np.log(p)
    alpha = long_forward(word, vocabulary, unknown, ln_p[:, None])[:, 0]
    beta = np.full(len(word) + 1, -np.inf)
    beta[-1] = 0
    for s in range(len(word) - 1, -1, -1):
        for e, k in edges(word, s, vocabulary, unknown):
            flow = ln_p[k] + beta[e]
            beta[s] = np.logaddexp(beta[s], flow)
            used[k] += weight * np.exp(alpha[s] + flow - alpha[-1])


def pieces(path: str = VOCABULARY) -> list[str]:
    """The ordinary pieces of a vocabulary file, read on the driver."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return sorted({p.piece for p in model.pieces if p.type == 1 and (p.piece == MARK or p.piece.lstrip(MARK))})


class Lattice:
    """The edges (word, start, end, piece) of all segmentations of some words, sorted by end and word."""

    def __init__(self, vocabulary: dict[str, int], words: list[str], unknown: int) -> None:
        w_, s_, e_, p_ = [], [], [], []
        for k, word in enumerate(words):
            for s in range(len(word)):
                for e, p in edges(word, s, vocabulary, unknown):
                    w_.append(k), s_.append(s), e_.append(e), p_.append(p)
        self.n, self.lengths = len(words), np.array([len(w) for w in words], np.int64)
        e = np.array(e_, np.int64)
        order = np.argsort(e, kind="stable")
        self.word, self.start, self.end, self.piece = (np.array(x, np.int64)[order] for x in (w_, s_, e_, p_))
        self.cuts = np.searchsorted(self.end, np.arange(1, (int(self.lengths.max()) if self.n else 0) + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[end, word, language]: scaled sum over the segmentations of the first characters. p: [piece, language], scaled."""
        top = len(self.cuts)
        alpha = np.zeros((top, self.n, p.shape[1]))
        alpha[0] = 1
        for e in range(1, top):
            lo, hi = self.cuts[e - 1], self.cuts[e]
            if lo < hi:
                w = self.word[lo:hi]
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                alpha[e, w[first]] = np.add.reduceat(alpha[self.start[lo:hi], w] * p[self.piece[lo:hi]], first)
        return alpha

    def logs(self, p: np.ndarray) -> np.ndarray:
        """ln of the probability of every word in every language."""
        if not self.n:
            return np.zeros((0, p.shape[1]))
        return np.log(self.forward(p)[self.lengths, np.arange(self.n)]) - self.lengths[:, None] * np.log(GAIN)

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all segmentations of the weighted words, in one language. p: [piece]."""
        alpha = self.forward(p[:, None])[:, :, 0]
        total = alpha[self.lengths, np.arange(self.n)]
        beta = np.zeros_like(alpha)
        beta[self.lengths, np.arange(self.n)] = weight / total
        used = np.zeros(len(p))
        for e in range(len(self.cuts) - 1, 0, -1):
            lo, hi = self.cuts[e - 1], self.cuts[e]
            flow = p[self.piece[lo:hi]] * beta[e, self.word[lo:hi]]
            np.add.at(beta, (self.start[lo:hi], self.word[lo:hi]), flow)
            np.add.at(used, self.piece[lo:hi], flow * alpha[self.start[lo:hi], self.word[lo:hi]])
        return used


def with_prefixes(vocabulary: list[str]) -> dict[str, int]:
    """Piece to number, and -1 for strings that only begin a piece."""
    known = {p: i for i, p in enumerate(vocabulary)}
    for p in vocabulary:
        for k in range(1, len(p)):
            known.setdefault(p[:k], -1)
    return known


def scaled(p: np.ndarray, vocabulary: list[str]) -> np.ndarray:
    """Probabilities [piece and unknown, ...] times GAIN for each character."""
    size = np.array([len(x) for x in vocabulary] + [1], float)
    return p * (GAIN**size).reshape(-1, *[1] * (p.ndim - 1))


def learn(texts: list[str | None], vocabulary: list[str], known: dict[str, int], rounds: int = ROUNDS, smooth: float = 0.02) -> np.ndarray:
    """Piece probabilities of the language of some texts; the last is that of an unknown character."""
    counts = Counter(w for t in texts for w in letters(t))
    words = sorted(counts)
    v = len(vocabulary)
    p = np.full(v + 1, 1 / (v + 1))
    if words:
        short, long = [w for w in words if len(w) <= LONG], [w for w in words if len(w) > LONG]
        lattice, weight = Lattice(known, short, v), np.array([counts[w] for w in short], float)
        for _ in range(rounds):
            used = lattice.expected(scaled(p, vocabulary), weight)
            for w in long:
                long_expected(w, known, v, p, counts[w], used)
            p = (used + smooth) / (used.sum() + smooth * (v + 1))
    return p


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, path: str = VOCABULARY) -> dict:
    """The model: languages, ln priors, scaled piece probabilities [piece, language]. docs: doc_id, text, lang of the rows to learn from."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = sorted((r["lang"], r["count"]) for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect())
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    vocabulary = pieces(path)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        vocab = shared.value
        p = learn(rows.sort_values(["doc_id", "text"])["text"].tolist(), vocab, with_prefixes(vocab))
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "p": [p]})

    sample = bounded_sample(labelled.select("doc_id", "text", "lang"), "lang", per_language)
    learned = {r["lang"]: np.array(r["p"]) for r in sample.groupBy("lang").applyInPandas(one, "lang string, p array<double>").collect()}
    langs = sorted(learned)
    n = np.array([dict(counts)[x] for x in langs], float)
    p = np.stack([learned[x] for x in langs], 1) if langs else np.zeros((len(vocabulary) + 1, 0))
    return {"langs": langs, "prior": np.log(n / n.sum()) if langs else n, "p": scaled(p, vocabulary).astype(np.float32), "vocabulary": vocabulary}


class Scorer:
    """Scores texts with a model; keeps the scores of words it has met, within bounds."""

    def __init__(self, model: dict) -> None:
        self.model, self.known = model, with_prefixes(model["vocabulary"])
        self.p = model["p"].astype(float)
        with np.errstate(divide="ignore"):
            self.ln_p = np.log(self.p) - np.array([len(x) for x in model["vocabulary"]] + [1])[:, None] * np.log(GAIN)
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((CACHE + 1, len(self.model["langs"])))

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            new = words[at : at + 20_000]
            if len(self.rows) + len(new) > CACHE:
                return
            n = len(self.rows)
            self.logs[n : n + len(new)] = Lattice(self.known, new, len(self.model["vocabulary"])).logs(self.p)
            self.rows.update(zip(new, range(n, n + len(new)), strict=True))

    def totals(self, words: list[str]) -> np.ndarray:
        """ln likelihood of the words in each language."""
        if any(len(w) > LONG for w in words):
            long = sum(long_forward(w, self.known, len(self.model["vocabulary"]), self.ln_p)[-1] for w in words if len(w) > LONG)
            return long + self.totals([w for w in words if len(w) <= LONG])
        rows = list(map(self.rows.get, words))
        if None in rows:
            new = sorted({w for w, r in zip(words, rows, strict=True) if r is None})
            if len(self.rows) + len(new) > CACHE:
                self._forget()
                new = sorted(set(words))
            if len(new) > CACHE:  # more words than the cache holds: in parts, nothing is kept
                half = len(words) // 2
                return self.totals(words[:half]) + self.totals(words[half:])
            self._learn(new)
            rows = list(map(self.rows.get, words))
        return self.logs[rows].sum(0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of a text and its posterior."""
        return self.judge(letters(text))

    def judge(self, words: list[str]) -> tuple[str, float]:
        """The language of the marked words of a text and its posterior."""
        if not words or not self.model["langs"] or not any(c.isalpha() for w in words for c in w[1:]):
            return "und", 0.0
        x = self.totals(words) + self.model["prior"]
        x = np.exp(x - x.max())
        k = int(x.argmax())
        return self.model["langs"][k], float(x[k] / x.sum())


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, lang_pred and score of every text. The words of many texts are scored together."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [f"_k{i}" for i in range(len(keep))]  # the columns may have any names
    ready = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, own, strict=True)), F.col("text").alias("_text"))
    kinds = ", ".join(f"{k} {ready.schema[k].dataType.simpleString()}" for k in own)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            texts = b.column(len(keep))
            for at in range(0, max(1, len(texts)), 512):
                part = [letters(t) for t in texts.slice(at, 512).to_pylist()]
                scorer._learn(sorted({w for ws in part for w in ws if len(w) <= LONG and w not in scorer.rows}))
                got = [scorer.judge(ws) for ws in part]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, 512) for i in range(len(keep))), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*own, "lang_pred", "score"])

    done = ready.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return done.select(*(F.col(k).alias(c) for c, k in zip(keep, own, strict=True)), "lang_pred", "score")
