"""Draw-addressable random numbers: Philox4x32-10 (Salmon et al. 2011) on numpy arrays. Every word is a function of seed, draw and position alone.

The key is the seed, mixed as splitmix64 mixes its state; the counter holds the block in its low and draw ^ tag in its high 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U32, U64 = np.uint32, np.uint64
#: Domain separation tags, eight ASCII letters each.
STREAM_TAG_RESAMPLE = int.from_bytes(b"RESAMPLE", "big")
STREAM_TAG_SIGNFLIP = int.from_bytes(b"SIGNFLIP", "big")
STREAM_TAG_RLRT = int.from_bytes(b"RLRTNULL", "big")
STREAM_TAG_SIMULATE = int.from_bytes(b"SIMULATE", "big")
_MASK = (1 << 64) - 1
#: Multipliers and key increments of Philox4x32.
_M0, _M1, _W0, _W1 = 0xD2511F53, 0xCD9E8D57, 0x9E3779B9, 0xBB67AE85


def splitmix64(seed: int) -> int:
    """The output mixing of splitmix64."""
    z = seed & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return z ^ (z >> 31)


def words(seed: int, draws: np.ndarray, tag: int, count: int, start: int = 0) -> np.ndarray:
    """Words start to start + count of the streams of some draws: [draw, word]."""
    first, last = start // 4, (start + count + 3) // 4
    stream = np.asarray(draws, U64) ^ U64(tag)
    block = np.arange(first, last, dtype=U64)
    shape = (len(stream), len(block))
    low = U64(0xFFFFFFFF)
    c0, c1 = (np.broadcast_to(x, shape) for x in (block & low, block >> U64(32)))
    c2, c3 = (np.broadcast_to(x[:, None], shape) for x in (stream & low, stream >> U64(32)))
    key = splitmix64(seed & _MASK)
    k0, k1 = key & 0xFFFFFFFF, key >> 32
    for _ in range(10):
        p0, p1 = U64(_M0) * c0, U64(_M1) * c2
        c0, c1, c2, c3 = (p1 >> U64(32)) ^ c1 ^ U64(k0), p1 & low, (p0 >> U64(32)) ^ c3 ^ U64(k1), p0 & low
        k0, k1 = (k0 + _W0) & 0xFFFFFFFF, (k1 + _W1) & 0xFFFFFFFF
    out = np.stack((c0, c1, c2, c3), -1).reshape(len(stream), -1).astype(U32)
    return out[:, start - 4 * first :][:, :count]


def bounded_words(seed: int, draw: int, n: int, start: int, count: int, tag: int = STREAM_TAG_RESAMPLE) -> np.ndarray:
    """The integers in [0, n) that some words of a draw give (Lemire 2019), n below 2^32. A rejected word gives none; whether it is rejected depends on the word alone."""
    m = words(seed, np.array([draw & _MASK], U64), tag, count, start)[0].astype(U64) * U64(n)
    return (m >> U64(32))[(m & U64(0xFFFFFFFF)) >= U64((1 << 32) % n)].astype(U32)


def falling_bounds(seed: int, draw: int, n: int, tag: int = STREAM_TAG_RESAMPLE, block: int = 1 << 14) -> np.ndarray:
    """One integer in [0, b) for each b = n, n - 1, .. 2, from the words of a draw. A rejected word moves the later ones up by a bound."""
    bounds = np.arange(n, 1, -1, dtype=U64)
    out, done, at, held = np.empty(len(bounds), U32), 0, 0, np.zeros(0, U64)
    while done < len(bounds):
        if not len(held):
            size = min(block, len(bounds) - done)
            held = words(seed, np.array([draw & _MASK], U64), tag, size, at)[0].astype(U64)
            at += size
        b = bounds[done : done + len(held)]
        m = held[: len(b)] * b
        bad = np.flatnonzero((m & U64(0xFFFFFFFF)) < U64(1 << 32) % b)
        k = int(bad[0]) if len(bad) else len(b)
        out[done : done + k] = m[:k] >> U64(32)
        done, held = done + k, held[k + 1 :]
    return out


class Stream:
    """The words of one draw, one after another."""

    def __init__(self, seed: int, draw: int, tag: int = STREAM_TAG_RESAMPLE) -> None:
        self.seed, self.draw, self.tag, self.at, self.held = seed, draw, tag, 0, np.zeros(0, U32)

    def fill_u32(self, n: int) -> np.ndarray:
        if self.at + n > len(self.held):
            more = words(self.seed, np.array([self.draw & _MASK], U64), self.tag, max(64, len(self.held), n), len(self.held))[0]
            self.held = np.concatenate((self.held, more))
        self.at += n
        return self.held[self.at - n : self.at]

    def next_u32(self) -> int:
        return int(self.fill_u32(1)[0])

    def bounded(self, n: int) -> int:
        """An unbiased integer in [0, n) (Lemire 2019)."""
        m = self.next_u32() * n
        if (m & 0xFFFFFFFF) < n:
            least = (1 << 32) % n
            while (m & 0xFFFFFFFF) < least:
                m = self.next_u32() * n
        return m >> 32

    def uniform(self) -> float:
        """In the open interval (0, 1), of 32 bits."""
        return (self.next_u32() + 0.5) / 2.0**32

    def uniform52(self) -> float:
        """In the open interval (0, 1), of 52 bits."""
        hi, lo = self.next_u32(), self.next_u32()
        return ((hi << 20 | lo >> 12) + 0.5) / 2.0**52


def uniforms(seed: int, draws: np.ndarray, tag: int = STREAM_TAG_SIMULATE) -> np.ndarray:
    """uniform52 of the first words of each draw."""
    w = words(seed, draws, tag, 2).astype(U64)
    return ((w[:, 0] << U64(20) | w[:, 1] >> U64(12)).astype(float) + 0.5) / 2.0**52


def sampled(spark: SparkSession, transform, n: int, seed: int, partitions: int = 8) -> DataFrame:
    """(draw, value): transform of the uniform number of each draw."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.asarray(transform(uniforms(seed, ids.to_numpy())), float))], ["draw", "value"])

    return spark.range(0, n, 1, partitions).mapInArrow(run, "draw long, value double")
