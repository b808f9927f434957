"""64-bit hashes of words and word grams in numpy, the same in every worker."""

from __future__ import annotations

import numpy as np


class WordHashes(dict):
    """word (bytes) -> XXH64; bounded by clear() between batches."""

    def __init__(self, most: int = 400_000) -> None:
        from xxhash import xxh64_intdigest

        super().__init__()
        self.most, self.digest = most, xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        h = self.digest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of two hashes."""
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += b
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def longer(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    """Hash at i of the gram of a at i and that of b at i + by."""
    n = max(0, min(len(a), len(b) - by))
    return mix(a[:n], b[by : by + n])
