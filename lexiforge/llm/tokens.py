"""Byte-level BPE ids, equal to those of the ``tokenizers`` library for the same vocabulary file.

A chunk is what lies between two single spaces. The pre-tokeniser's pattern never matches across the
boundary before a space that is followed by a non-space, so chunks are encoded apart and their ids are
kept in a bounded cache; most words of a corpus are repeats. Added tokens, like an end-of-text mark, are taken
out of the text first, the longest where several begin, and have their own id; what is between is encoded apart.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

_SPACE_RUN = re.compile(r" (?=\s|\Z)")
_BEFORE_WORD = re.compile(r"(?= \S)")


def _byte_of_char() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Chunks(dict):
    """Chunk (without its leading space) to packed little-endian ids; emptied when it holds ``limit`` entries."""

    def __init__(self, encode, lead: str, limit: int):
        super().__init__()
        self.encode, self.lead, self.limit = encode, lead, limit

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(self.lead + chunk), dtype="<u4").tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = ids
        return ids


class ByteBpe:
    def __init__(self, path: str, limit: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        encode = None
        joined = ("".join(m if isinstance(m, list) else m.split(" ")) for m in merges)
        if all(vocab.get(m) == 256 + i for i, m in enumerate(joined)):
            import tiktoken
            from public_tokenizers import PATTERN

            byte = _byte_of_char()
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
            encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:  # ids are not in merge order: the library itself encodes the chunks
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            encode = lambda text: own.encode(text, add_special_tokens=False).ids
        self.first, self.rest = _Chunks(encode, "", limit // 10), _Chunks(encode, " ", limit)
        added = spec.get("added_tokens") or []
        strange = [t["content"] for t in added if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
        if strange:
            raise ValueError(f"added tokens that take in their surroundings are not known here: {strange}")
        self.added = {t["content"]: np.array([t["id"]], dtype="<u4") for t in added}
        self.mark = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if added else None

    def encode(self, text: str) -> np.ndarray:
        if any(c in text for c in self.added):
            return np.concatenate([self.added[x] if i % 2 else self._plain(x) for i, x in enumerate(self.mark.split(text))])
        return self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        if _SPACE_RUN.search(text):
            head, *tail = _BEFORE_WORD.split(text)
            tail = [x[1:] for x in tail]
        else:
            head, *tail = text.split(" ")
        return np.frombuffer((self.first[head] if head else b"") + b"".join(map(self.rest.__getitem__, tail)), dtype="<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)
