"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding maps capitals, accents' base homoglyphs, look-alike letters of other scripts and digit substitutions to
plain letters, and everything that isn't a letter to one space. Entries are whole words or stems, which start a
word. They and their weights (log odds that a text with the entry is toxic) are learnt from a bounded sample of
labelled texts: entries are taken one by one, each time the one with most weight on words of toxic texts that no entry
matches yet. Exception phrases are an entry with the word before or after it, if that phrase occurs in clean texts and
in no toxic one; a match inside one does not count. The sum of weights is divided by a slow function of length
and mapped to 0..1 by a logistic curve fitted to the same sample.

Null or empty text: no match, the score of that. Without labels of both kinds every score is the share of toxic
ones (0 without any). Repeated rows get equal scores; repeated labels count once, and of rows that share an id the
least text is learnt from; a null doc_id has no label. Only
``doc_id``, ``text`` and the labels' ``toxic`` are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import bounded, bucket_of, table, trimmed

SAMPLE_PER_LABEL = 3000
MIN_STEM, MAX_STEM = 3, 12
MIN_WEIGHT = 2.0
OWN_SHARE, COMMON_SHARE = 0.03, 0.05
MAX_ENTRIES = 5000

# Look-alikes of Latin letters, then digits and signs in their place.
_LOOK_ALIKES = "аa вb сc еe ѕs іi јj кk мm нh оo рp тt уy хx αa βb εe ιi κk νv οo ρp τt υu χx ıi ɡg ℓl ⅼl"
_DIGITS = "0o 1i 3e 4a 5s 7t 8b 9g"
_SIGNS = "@a $s !i"


def _table() -> dict[int, str]:
    """Every letter of the Latin blocks to its base letter in lower case, with the look-alikes and digits; controls and marks of these blocks to a space."""
    out = {}
    for c in map(chr, [*range(0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFF00, 0xFF60)]):
        base = unicodedata.normalize("NFKD", c)[:1].lower()
        out[ord(c)] = base if base.isalpha() else " "
    for pair in f"{_LOOK_ALIKES} {_DIGITS}".split():
        out[ord(pair[0])] = out[ord(pair[0].upper())] = pair[1]
    for c in [*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]:
        out[c] = ""
    return out


_FOLD = _table()
_SIGN = re.compile(r"(?<![^\W_])[@$](?=[^\W_])|(?<=[^\W_])[@$!](?=[^\W_])")
_SIGN_OF = dict(_SIGNS.split()[i] for i in range(3))
_BLANKS = re.compile(r" {2,}")


def fold(text: str | None) -> str:
    """Folded words between single spaces, with one at either end."""
    text = _SIGN.sub(lambda m: _SIGN_OF[m[0]], text or "")
    return " " + " ".join(text.translate(_FOLD).split()) + " "


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " word " or " stem"
    exceptions: tuple[str, ...] = ()  # " two words "
    slope: float = 1.0
    bias: float = 0.0
    prior: float | None = None  # the score of all texts, if there was nothing to learn

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            out.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), None))
        out.make_automaton()
        return out


def raw_score(folded: str, automaton: ahocorasick.Automaton) -> float:
    """Sum of the weights of matches outside exception phrases, over 1 + log10(1 + words / 1000)."""
    if not len(automaton):
        return 0.0
    hits, safe = [], []
    for end, (size, weight) in automaton.iter(folded):
        (safe if weight is None else hits).append((end - size + 1, end, weight))
    if safe:
        hits = [h for h in hits if not any(s[0] <= h[0] and h[1] <= s[1] for s in safe)]
    if not hits:
        return 0.0
    words = folded.count(" ") - 1
    return sum(w for _, _, w in hits) / (1 + math.log10(1 + words / 1000))


def _entries(word: str) -> list[str]:
    whole = [f" {word} "] if len(word) >= 3 else []
    return whole + [f" {word[:n]}" for n in range(MIN_STEM, min(len(word), MAX_STEM) + 1)]


def _candidates(folded: str) -> set[str]:
    return {c for word in set(folded.split()) for c in _entries(word)}


def _logistic(x: list[float], y: list[int], rounds: int = 50) -> tuple[float, float]:
    """Slope and bias by Newton steps with a small ridge."""
    a = b = 0.0
    for _ in range(rounds):
        g0 = g1 = 0.0
        h00 = h11 = 1e-3
        h01 = 0.0
        for v, t in zip(x, y, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * v + b))))
            w = p * (1 - p)
            g0, g1 = g0 + (p - t) * v, g1 + p - t
            h00, h01, h11 = h00 + w * v * v, h01 + w * v, h11 + w
        g0, g1 = g0 + 1e-3 * a, g1 + 1e-3 * b
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def fit(texts: list[str | None], labels: list[int]) -> Lexicon:
    rows = sorted({(fold(t), y) for t, y in zip(texts, labels, strict=True)})  # a copy is no further evidence
    folded, labels = [f for f, _ in rows], [y for _, y in rows]
    n = [labels.count(0), labels.count(1)]
    if not n[0] or not n[1]:
        return Lexicon(prior=n[1] / sum(n) if sum(n) else 0.0)
    toxic = Counter(c for f, y in rows if y for c in _candidates(f))
    # So many toxic texts and no clean one are not met by chance by any candidate.
    support = max(3, math.ceil(math.log(len(toxic) + 1) / math.log(sum(n) / n[1])))
    open_to = {c for c, k in toxic.items() if k >= support}
    clean = Counter(c for f, y in rows if not y for c in _candidates(f) & open_to)
    odds = lambda c: math.log((toxic[c] + 0.5) / (n[1] + 1)) - math.log((clean[c] + 0.5) / (n[0] + 1))
    weight = {c: w for c in open_to if (w := odds(c)) >= MIN_WEIGHT and toxic[c] >= 8 * clean[c]}
    where: dict[str, set[tuple[int, str]]] = {c: set() for c in weight}
    for i, (f, y) in enumerate(rows):
        for word in set(f.split()) if y else ():
            for c in _entries(word):
                if c in where:
                    where[c].add((i, word))
    chosen: dict[str, float] = {}
    explained: set[int] = set()
    while where and len(chosen) < MAX_ENTRIES:
        best = max(where, key=lambda c: (len(where[c]) * weight[c], len(c), c))
        covered = where.pop(best)
        own = {i for i, _ in covered}
        # A word that just tends to stand beside entries explains almost no toxic text by itself, and isn't common.
        if len(own - explained) < max(2, OWN_SHARE * len(own)) and len(own) < COMMON_SHARE * n[1]:
            continue
        chosen[best] = weight[best]
        explained |= own
        where = {c: rest for c, seen in where.items() if len(rest := seen - covered) >= support}

    around: list[Counter[str]] = [Counter(), Counter()]
    probe = Lexicon(weights=chosen).automaton()
    for f, y in zip(folded, labels, strict=True):
        for end, (size, _) in probe.iter(f) if len(probe) else ():
            start = end - size + 1
            stop = f.index(" ", start + 1)
            before = f.rfind(" ", 0, start) if start else -1
            after = f.find(" ", stop + 1)
            around[y].update({f[a : b + 1] for a, b in ((before, stop), (start, after)) if a >= 0 and b > 0})
    lexicon = Lexicon(weights=chosen, exceptions=tuple(sorted(p for p, k in around[0].items() if k >= 2 and not around[1][p])))
    automaton = lexicon.automaton()
    lexicon.slope, lexicon.bias = _logistic([raw_score(f, automaton) for f in folded], labels)
    return lexicon


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> tuple[list[str | None], list[int]]:
    """About ``per_label`` labelled texts of either kind, chosen by a hash of the id; labels are 0 or 1, others are left out."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where(bucket_of("id", 5) != 0).distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, min(1.0, per_label / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 20)) / float(1 << 20)
    picked = known.where(draw < share)
    own = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    rows = own.join(bounded(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()  # one text an id
    rows.sort(key=lambda r: (r["id"], r["text"] or ""))
    return [r["text"] for r in rows], [r["y"] for r in rows]


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted, raw (the normalised sum of weights)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            raw = [raw_score(fold(t), automaton) for t in batch["text"]]
            if lexicon.prior is None:
                out = [1 / (1 + math.exp(-max(-700.0, min(700.0, lexicon.slope * x + lexicon.bias)))) for x in raw]
            else:
                out = [lexicon.prior] * len(raw)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": out, "predicted": [int(p >= 0.5) for p in out], "raw": raw})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(trimmed(run), "doc_id long, score double, predicted int, raw double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = fit(*training_sample(docs, table(spark, sf_dir, "labels")))
    return score(docs, lexicon).select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
