"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of a language's most common words are compared
with those of each language by the Jensen-Shannon distance (base 2, 0 to 1). The references are sums over all
documents with a language; common words have a letter or digit. A document is kept if for some language both
distances are within their limits; to the square of a limit comes the divergence that sampling alone gives a
text of that length, and a histogram of fewer items than its minimum length is not judged.

Null or empty text: all counts 0, base_failed. Documents without a language join no reference but are judged.
Without any reference (an empty table, no language) the divergence rejects nothing. Rows are judged one by one,
so repeated rows get equal results. Only ``doc_id``, ``text`` and ``lang`` are read, so further columns cannot
clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.llm.common import table, trimmed

COMMON_WORDS = 40
MAX_CHAR_DISTANCE, MIN_CHARS = 0.25, 200
MAX_WORD_DISTANCE, MIN_WORDS = 0.25, 50
SPACES = (9, 10, 11, 12, 13, 32)
SYMBOLS = b"#*$%&|<>"
STRIP = b".,;:!?()[]\"'"
_HELD = 1 << 20


def _classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, blank, sentence mark, symbol, other mark, other letter, control; -1: inside a character."""
    out = np.full(256, 8)
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[list(SPACES)] = 3
    out[[c for c in range(33, 127) if not chr(c).isalnum()]] = 6
    out[list(b".,;:'\"-()?")] = 4
    out[list(SYMBOLS)] = 5
    out[128:192], out[192:256] = -1, 7
    return out


CLASSES = _classes()
N_CLASSES = 9
_MEMBER = np.array([CLASSES == k for k in range(N_CLASSES)]).astype(np.int64)


def char_classes(raw: bytes) -> np.ndarray:
    return _MEMBER @ np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of p to each row of q; both are counts."""
    p, q = p / max(p.sum(), 1), q / np.maximum(q.sum(axis=-1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(axis=-1)
        return np.sqrt(np.clip((kl(np.broadcast_to(p, m.shape)) + kl(q)) / 2, 0, 1))


def limit(most: float, items: int, bins: int) -> float:
    """most, and in quadrature the distance that drawing so few items from the reference itself gives, to first order."""
    return float(np.sqrt(most**2 + bins / (8 * np.log(2) * max(items, 1))))


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    chars = int(counts.sum() - counts[128:192].sum() - counts[list(SPACES)].sum())
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    n, repeated = len(words), 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
        two = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)[1]
        _, which, times = np.unique(two * len(number) + ids[2:], return_inverse=True, return_counts=True)
        again = times[which] > 1
        covered = np.zeros(n, dtype=bool)
        for i in range(3):
            covered[i : n - 2 + i] |= again
        repeated = int(covered.sum())
    return n, chars, int(counts[list(SYMBOLS)].sum()), dup, repeated


def _plain(raw: bytes) -> list[bytes]:
    return [w.strip(STRIP) for w in raw.lower().split()]


def references(docs: DataFrame, common: int = COMMON_WORDS) -> dict[str, tuple[np.ndarray, dict[bytes, int]]]:
    """Language to (counts of character classes, counts of its ``common`` most common words, b"" for all others)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        chars: dict[str, np.ndarray] = {}
        totals: Counter[str] = Counter()

        def rows() -> pd.DataFrame:
            out = [(lang, w, n) for lang, c in words.items() for w, n in c.items()]
            words.clear()
            return pd.DataFrame(out, columns=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                own = _plain(raw)
                words.setdefault(lang, Counter()).update(own)
                totals[lang] += len(own)
                chars[lang] = chars.get(lang, 0) + char_classes(raw)
            if sum(map(len, words.values())) > _HELD:
                yield rows()
        yield rows()
        out = [(lang, b"\x00%d" % k, n) for lang, c in chars.items() for k, n in enumerate([*c, totals[lang]])]
        yield pd.DataFrame(out, columns=["lang", "word", "n"])

    own = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    # A language's words share no key, so a language with most rows is no hot group; ranks are cut before the shuffle by language.
    counts = own.mapInPandas(trimmed(count), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    kind = F.when(F.substring("word", 1, 1) == F.lit(b"\x00"), 0).when(~F.col("word").cast("string").rlike(r"[\p{L}\p{N}]"), 1).otherwise(2)
    per = W.partitionBy("lang", "kind").orderBy(F.desc("n"), "word")
    top = counts.withColumn("kind", kind).where("kind <> 1").withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= max(common, N_CLASSES + 1))
    found: dict[str, tuple[np.ndarray, dict[bytes, int]]] = {}
    for r in top.collect():
        chars, words = found.setdefault(r["lang"], (np.zeros(N_CLASSES + 1), {}))
        if r["kind"] == 0:
            chars[int(bytes(r["word"])[1:])] = r["n"]
        elif r["rank"] <= common:
            words[bytes(r["word"])] = r["n"]
    sums = {k: int(c[-1]) for k, (c, _) in found.items()}
    return {k: (c[:-1], w | {b"": sums[k] - sum(w.values())}) for k, (c, w) in found.items()}


def judge(docs: DataFrame, refs: dict[str, tuple[np.ndarray, dict[bytes, int]]], max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, language (the nearest), char_distance, word_distance."""
    langs = sorted(refs)
    chars = np.array([refs[k][0] for k in langs]).reshape(len(langs), N_CLASSES)
    lists = [[w for w in refs[k][1] if w] for k in langs]
    freqs = [np.array([refs[k][1][w] for w in own] + [refs[k][1][b""]], dtype=float) for k, own in zip(langs, lists, strict=True)]
    number = {w: i for i, w in enumerate(sorted({w for own in lists for w in own}))}
    places = [np.array([number[w] for w in own], dtype=np.int64) for own in lists]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                raw = (text or "").encode("utf-8", "surrogatepass")
                base = base_counts(raw)
                n_words, failed = base[0], base[0] < 50 or 100 * base[4] > 50 * base[0]
                best, lang, dc, dw = 0.0 if langs else -1.0, None, None, None
                if langs and n_words:
                    own = char_classes(raw)
                    common = np.bincount(np.fromiter((number.get(w, len(number)) for w in _plain(raw)), dtype=np.int64, count=n_words), minlength=len(number) + 1)
                    far = distance(own, chars)
                    over_c = far - limit(max_char, int(own.sum()), N_CLASSES) if own.sum() >= min_chars else np.full(len(langs), -1.0)
                    near = [common[p] for p in places]
                    words = np.array([distance(np.append(x, n_words - x.sum()), f) for x, f in zip(near, freqs, strict=True)])
                    over_w = words - np.array([limit(max_word, n_words, len(f)) for f in freqs]) if n_words >= min_words else np.full(len(langs), -1.0)
                    over = np.maximum(over_c, over_w)
                    k = int(np.argmin(over + 1e-9 * (far + words)))
                    best, lang, dc, dw = float(over[k]), langs[k], float(far[k]), float(words[k])
                rows.append((*base, failed, not failed and best <= 0, lang, dc, dw))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "language", "char_distance", "word_distance"]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"])
            yield out

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, language string, char_distance double, word_distance double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(trimmed(run), schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, references(docs))
