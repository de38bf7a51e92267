"""Hashed words of whole texts, for operators that compare word windows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from xxhash import xxh3_64_intdigest

#: Odd multipliers, one for each place of a window; drawn from a fixed seed.
PLACES = np.random.default_rng(20240607).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


class WordHash(dict):
    """UTF-8 word -> 64-bit hash; holds at most ``most`` words at once."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of bytes other than 20 and 09-0D; ``lower`` folds A-Z only."""
    b = utf8(text)
    return (b.lower() if lower else b).split()


def chunks(texts: list[str | None], most: int = 2_000_000) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters together, or one longer text."""
    begin = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def joined(known: WordHash, found: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts end to end, and where each text starts (and the last ends)."""
    starts = np.concatenate([[0], np.cumsum([len(w) for w in found])]).astype(np.int64)
    if len(known) > known.most:
        known.clear()
    return np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.uint64, int(starts[-1])), starts


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each window of ``size`` words (none if there are fewer)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, size * 0x9E3779B97F4A7C15 + seed & (2**64 - 1), np.uint64)
    for i in range(size):
        total += h[i : i + n] * PLACES[(i + 17 * seed) % 64]
    return mix(total)
