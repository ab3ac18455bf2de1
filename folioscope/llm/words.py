"""Words as the operators of this subpackage compare them: maximal runs of letters and digits, lower case."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """[] for null and blank texts; texts of any length are taken whole."""
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """Stable 64-bit hashes of words, remembered as long as there are not too many."""

    MOST = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place of a keyed hash per element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, one per position; shorter inputs have none."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out + h[i : len(h) - n + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return out
