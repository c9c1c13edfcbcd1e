"""Elias-Fano sequences and an n-gram trie made of them, in flat arrays that can be memory-mapped."""

from __future__ import annotations

import os
import struct
import tempfile

import numpy as np

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)
_SELECT = np.array([[(np.flatnonzero([b >> k & 1 for k in range(8)]).tolist() + [8] * 8)[i] for i in range(8)] for b in range(256)], dtype=np.int64)


def joined(parts: list[bytes]) -> bytes:
    """Several strings of bytes as one."""
    return b"".join([struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)), *parts])


def parted(raw: bytes) -> list[memoryview]:
    """The strings of bytes that ``joined`` has put together."""
    n = struct.unpack_from("<q", raw)[0]
    out, at = [], 8 * (n + 1)
    for size in struct.unpack_from(f"<{n}q", raw, 8):
        out.append(memoryview(raw)[at : at + size])
        at += size
    return out


class EliasFano:
    """A monotone sequence of n integers below ``universe``: low bits in whole bytes, high bits in unary.

    About 2 + log2(universe / n) bits for each, the low ones rounded to whole bytes. ``at`` gives values by their
    places; ``rank`` the place of the first value not below x, by its high bits first.
    """

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bytes, self.low, self.high = n, low_bytes, low, high
        self.ones = np.concatenate([[0], np.cumsum(_POPCOUNT[high])])
        self.zeros = 8 * np.arange(len(self.ones)) - self.ones

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.ascontiguousarray(values, dtype="<u8")
        n = len(values)
        low_bits = max(0, (int(universe) // max(n, 1)).bit_length() - 1)
        low_bytes = min(7, (low_bits + 5) // 8)  # up to two bits more in unary take less than the rest of a byte
        low = np.ascontiguousarray(values.view(np.uint8).reshape(n, 8)[:, :low_bytes]).ravel()
        ones = (values >> np.uint64(8 * low_bytes)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 9) // 8 * 8 if n else 8, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, low_bytes, low, np.packbits(bits, bitorder="little"))

    def pack(self) -> bytes:
        return joined([struct.pack("<qq", self.n, self.low_bytes), self.low.tobytes(), self.high.tobytes()])

    @classmethod
    def unpack(cls, raw: bytes, keep=lambda _name, values: values) -> EliasFano:
        """keep: what to do with each array, for instance to map it."""
        head, low, high = parted(raw)
        n, low_bytes = struct.unpack("<qq", head)
        return cls(n, low_bytes, keep("low", np.frombuffer(low, dtype=np.uint8)), keep("high", np.frombuffer(high, dtype=np.uint8)))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), 8), dtype=np.uint8)
        if self.low_bytes:
            out[:, : self.low_bytes] = self.low.reshape(self.n, self.low_bytes)[i]
        return out.view("<u8").ravel()

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        return (high.astype(np.uint64) << np.uint64(8 * self.low_bytes)) | self._low(np.arange(self.n))

    def at(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        byte = np.searchsorted(self.ones, i, side="right") - 1
        high = byte * 8 + _SELECT[self.high[byte], i - self.ones[byte]] - i
        return (high.astype(np.uint64) << np.uint64(8 * self.low_bytes)) | self._low(i)

    def _start(self, high: np.ndarray) -> np.ndarray:
        """Values whose high bits are below ``high``."""
        k = high - 1  # they end at this zero
        inside = (k >= 0) & (k < self.zeros[-1])
        byte = np.searchsorted(self.zeros, np.where(inside, k, 0), side="right") - 1
        zero = byte * 8 + _SELECT[255 - self.high[byte], np.where(inside, k, 0) - self.zeros[byte]]
        return np.where(k < 0, 0, np.where(inside, zero - k, self.n))

    def rank(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """First place in [lo, hi) whose value isn't below x, else hi, for all x at once."""
        x = np.asarray(x, dtype=np.uint64)
        if not self.n:
            return np.zeros(len(x), dtype=np.int64)
        high = (x >> np.uint64(8 * self.low_bytes)).astype(np.int64)
        a, b = self._start(high), self._start(high + 1)
        if lo is not None:
            a, b = np.clip(a, lo, hi), np.clip(b, lo, hi)
        low = x & np.uint64((1 << 8 * self.low_bytes) - 1)
        while len(at := np.flatnonzero(a < b)):
            mid = (a[at] + b[at]) // 2
            below = self._low(mid) < low[at]
            a[at] = np.where(below, mid + 1, a[at])
            b[at] = np.where(below, b[at], mid)
        return a


class Trie:
    """Words in the order of their hashes, monotone pointers to their successors, these relative to their context, and quantised values of both.

    A successor s of word number r is the value r * 2**32 + s of one sequence; it is searched between the pointers of r.
    """

    def __init__(self, words: EliasFano, pointers: EliasFano, successors: EliasFano, counts: np.ndarray, backoff: np.ndarray, codes: np.ndarray):
        self.words, self.pointers, self.successors, self.counts, self.backoff, self.codes = words, pointers, successors, counts, backoff, codes

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, backoff: np.ndarray, pairs: np.ndarray, codes: np.ndarray) -> Trie:
        """words: sorted; pairs: (number of the word << 32 | successor), sorted; neither has repeats."""
        starts = np.searchsorted(pairs >> np.uint64(32), np.arange(len(words) + 1, dtype=np.uint64))
        return cls(EliasFano.encode(words, 1 << 64), EliasFano.encode(starts, len(pairs) + 1), EliasFano.encode(pairs, max(1, len(words)) << 32), counts.astype("<i8"), backoff.astype(np.uint8), codes.astype(np.uint8))

    def pack(self) -> bytes:
        return joined([*(x.pack() for x in (self.words, self.pointers, self.successors)), self.counts.tobytes(), self.backoff.tobytes(), self.codes.tobytes()])

    @classmethod
    def mapped(cls, raw: bytes, folder: str) -> Trie:
        """The trie with its levels in files of ``folder``, memory-mapped."""
        parts = parted(raw)
        levels = [EliasFano.unpack(x, lambda name, v, k=k: _mapped(folder, f"{k}.{name}", v)) for k, x in enumerate(parts[:3])]
        values = [np.frombuffer(x, dtype=t) for x, t in zip(parts[3:], ("<i8", np.uint8, np.uint8), strict=True)]
        return cls(*levels, *(_mapped(folder, f"values.{k}", v) for k, v in enumerate(values)))

    def find_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word and whether it is there."""
        r = self.words.rank(words)
        known = r < self.words.n
        known[known] = self.words.at(r[known]) == words[known]
        return r, known

    def find_pairs(self, r: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Codes of successors of the words numbered r; 0 for those that aren't there."""
        out = np.zeros(len(r), dtype=np.uint8)
        lo, hi = self.pointers.at(r).astype(np.int64), self.pointers.at(r + 1).astype(np.int64)
        x = (r.astype(np.uint64) << np.uint64(32)) | successors
        at = self.successors.rank(x, lo, hi)
        ok = np.flatnonzero(at < hi)
        ok = ok[self.successors.at(at[ok]) == x[ok]]
        out[ok] = self.codes[at[ok]]
        return out


def _mapped(folder: str, name: str, values: np.ndarray) -> np.ndarray:
    if not values.nbytes:
        return values
    path = os.path.join(folder, name)
    values.tofile(path)
    return np.memmap(path, dtype=values.dtype, mode="r")


def scratch() -> tempfile.TemporaryDirectory:
    """A folder of this task alone; it holds nothing that another task reads and goes when the task ends."""
    return tempfile.TemporaryDirectory(prefix="trie-")
