"""Vectorised hashing of words and shingles over the bytes of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers (fractions of the golden ratio and of roots), and the mixing of splitmix64.
BASE, FOLD = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
#: Bytes of text that are hashed together.
CHUNK = 1 << 20
#: Lower-cased ASCII letters, digits and all bytes of non-ASCII characters; 0 for separators.
WORD_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


class Powers:
    """Powers of BASE and of its inverse modulo 2 ** 64, as many as were needed so far."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            inverse = U(pow(int(BASE), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate((np.ones(1, U), np.full(n, BASE))))
            self.down = np.cumprod(np.concatenate((np.ones(1, U), np.full(n, inverse))))
        return self.up, self.down


POWERS = Powers()


def spans(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of symbols[start:end] for many spans: equal spans have equal hashes wherever they stand. Symbols are above 0."""
    n = len(symbols)
    up, down = POWERS(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(symbols.astype(U) * up[:n], out=total[1:])
    return (total[end] - total[start]) * down[start]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], (at - at[0]) if len(at) else np.zeros(1, np.int64)


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes; a longer row is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of some rows, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    low = WORD_BYTES[data]
    inside = low != 0
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[:-1]
    before[edges[edges < n]] = False
    edges = offsets[1:]
    after[edges[edges > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(offsets, start, "right") - 1, mix(spans(low, start, end))


def shingles(row: np.ndarray, words: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of k words: row, hash, times. Rows of fewer words, but not none, have one shingle of all their words."""
    parts_r, parts_h = [], []
    m = len(words)
    if m >= k:
        h = words[: m - k + 1].copy()
        for j in range(1, k):
            h *= FOLD
            h += words[j : m - k + 1 + j]
        same = row[: m - k + 1] == row[k - 1 :]
        parts_r.append(row[: m - k + 1][same])
        parts_h.append(mix(h[same]))
    count = np.bincount(row, minlength=n_rows)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.cumsum(count) - count
        h = count[few].astype(U)
        for j in range(k - 1):
            has = count[few] > j
            h[has] = h[has] * FOLD + words[first[few][has] + j]
        parts_r.append(few)
        parts_h.append(mix(h ^ BASE))
    if not parts_r:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    r, h = np.concatenate(parts_r), np.concatenate(parts_h)
    if len(few) and len(parts_r) > 1:
        order = np.argsort(r, kind="stable")
        r, h = r[order], h[order]
    return distinct(r, h, n_rows)


def distinct(row: np.ndarray, value: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of each row, sorted: row, value, times. Rows are in order."""
    value = value.copy()
    cut = np.searchsorted(row, np.arange(n_rows + 1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a > 1:
            value[a:b].sort()
    if not len(value):
        return row, value, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1]))))
    return row[new], value[new], np.diff(np.append(new, len(value)))
