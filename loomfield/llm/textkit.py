"""Pieces that several operators share: words and shingle hashes."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """Array of the words of a text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
STEP = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, in place."""
    x ^= x >> np.uint64(33)
    x *= MIX1
    x ^= x >> np.uint64(33)
    x *= MIX2
    x ^= x >> np.uint64(33)
    return x


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word of the text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII white space and letters only
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Hash of every run of `width` words in order; fewer words: one hash of the whole; no words: none."""
    words = word_hashes(text)
    n = len(words)
    if n == 0:
        return words
    take = min(n, width)
    out = np.full(n - take + 1, take, np.uint64)
    for i in range(take):
        out *= STEP
        out += words[i : n - take + 1 + i]
        out ^= out >> np.uint64(29)
    return scramble(out)


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of h -> (h ^ r) * a, a odd: bijections of the 64-bit integers."""
    rng = np.random.default_rng(seed)
    draw = rng.integers(0, 2**63, size=(2, count), dtype=np.uint64)
    return draw[0], draw[1] * np.uint64(2) + np.uint64(1)


def grouped_minima(hashes: np.ndarray, starts: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """(permutations, groups) minima; groups begin at `starts`, none is empty."""
    out = np.empty((len(xor), len(starts)), np.uint64)
    buffer = np.empty_like(hashes)
    for k in range(len(xor)):
        np.bitwise_xor(hashes, xor[k], out=buffer)
        np.multiply(buffer, mul[k], out=buffer)
        np.minimum.reduceat(buffer, starts, out=out[k])
    return out
