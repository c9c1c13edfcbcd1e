"""Words and shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """Runs of other characters than space and U+0009 to U+000D; A-Z in lower case, on request."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class Hashes(dict):
    """Word to 64-bit hash; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ x >> np.uint64(30)) * _A
    x = (x ^ x >> np.uint64(27)) * _B
    return x ^ x >> np.uint64(31)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; with fewer words, of the whole sequence."""
    size = min(size, len(hashes))
    if not size:
        return np.empty(0, dtype=np.uint64)
    n = len(hashes) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out = mix(out * _STEP + hashes[i : i + n])
    return out
