"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams of the lower-cased text, weighted by TF-IDF (1 + log of the count,
times the smoothed inverse document frequency over all documents to learn from) and scaled to unit length. The
weights are learnt by follow-the-regularised-leader steps with an elastic net, so most of them are exactly 0,
on a bounded sample of labelled texts; a part of the sample that is not learnt from sets the temperature.

Null text or text without a letter: ``und``, score 0. Without labelled texts every text is ``und``. Documents
with a null language are predicted but not learnt from. Repeated rows get equal results. Only ``doc_id``,
``text`` and ``lang`` are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import bounded, bucket_of, table, trimmed
from lexiforge.llm.words import mix

SAMPLE_PER_LANGUAGE = 800
BITS = 16
ORDERS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.001
EPOCHS = 3
_LETTER = re.compile(r"[^\W\d_]")
_HASHED = 1 << 22


def ngrams(text: str, bits: int = BITS, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the whole text and their counts."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    total = np.zeros(1 << bits, dtype=np.int64)
    for start in range(0, len(codes), _HASHED):
        part = codes[start : start + _HASHED + orders - 1]
        for n in range(1, orders + 1):
            h = np.full(max(0, min(_HASHED, len(part) - n + 1)), n, dtype=np.uint64)
            for i in range(n):
                h = h * np.uint64(0x1F123BB5_9E3779B1) + part[i : i + len(h)]
            total += np.bincount((mix(h) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    rows: np.ndarray  # feature to its row of weights; 0: a row of zeros
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        at, counts = ngrams(text)
        values = (1 + np.log(counts)) * self.idf[at]
        return (values / np.sqrt(values @ values)) @ self.weights[self.rows[at]] + self.bias


def document_frequency(docs: DataFrame, bits: int = BITS) -> np.ndarray:
    """Number of documents with each feature, over all rows; the last entry is the number of documents.

    Each task sums whole vectors and sends them in blocks, so the shuffle is bounded by tasks, not by texts.
    """
    block = 1 << 12

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((1 << bits) + block, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                total[ngrams(text, bits)[0]] += 1
                total[1 << bits] += 1
        yield pd.DataFrame({"block": np.arange(len(total) // block), "counts": [x.tobytes() for x in total.reshape(-1, block)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, dtype=np.int64) for x in pdf["counts"]], axis=0)
        return pd.DataFrame({"block": pdf["block"][:1], "counts": [total.tobytes()]})

    sent = docs.where("text is not null").select(F.col("text").cast("string")).mapInPandas(trimmed(count), "block long, counts binary")
    out = np.zeros((1 << bits) + block, dtype=np.int64)
    for r in sent.groupBy("block").applyInPandas(add, "block long, counts binary").collect():
        out[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(bytes(r["counts"]), dtype=np.int64)
    return out[: (1 << bits) + 1]


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """About ``per_language`` texts of each language, chosen by a hash of id and text, each text once, in an order that mixes languages."""
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    picked = docs.join(bounded(counts), "lang").where(draw < F.least(F.lit(1.0), per_language / F.col("n")))
    rows = picked.select("lang", "text").distinct().select("lang", "text", F.xxhash64("text").alias("h")).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["h"], r["text"]))]


def fit(sample: list[tuple[str, str]], df: np.ndarray, bits: int = BITS) -> Model | None:
    sample = [(t, y) for t, y in sample if _LETTER.search(t)]
    languages = sorted({y for _, y in sample})
    if not languages:
        return None
    k, size = len(languages), 1 << bits
    idf = np.log((1 + df[-1]) / (1 + df[:size])) + 1
    rows = []
    for text, lang in sample:
        at, counts = ngrams(text, bits)
        values = (1 + np.log(counts)) * idf[at]
        rows.append((at, values / np.sqrt(values @ values), languages.index(lang)))
    held = rows[::5] if len(rows) >= 50 else rows
    learn = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, (np.sign(own) * L1 - own) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    softmax = lambda x: (e := np.exp(x - x.max())) / e.sum()
    for _ in range(EPOCHS):
        for at, values, y in learn:
            at, values = np.append(at, size), np.append(values, 1.0)  # the last feature is the bias
            w = weights(at)
            p = softmax(values @ w)
            p[y] -= 1
            g = values[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    full = weights(np.arange(size + 1))
    used = np.flatnonzero(np.any(full[:size] != 0, axis=1))
    index = np.zeros(size, dtype=np.int64)
    index[used] = np.arange(1, len(used) + 1)
    model = Model(languages, idf, index, np.vstack([np.zeros((1, k)), full[used]]), full[size])
    scores = [(values @ full[at] + full[size], y) for at, values, y in held]
    loss = lambda t: -sum(math.log(max(softmax(s / t)[y], 1e-12)) for s, y in scores)
    lo, hi = math.log(0.05), math.log(20)
    for _ in range(40):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if loss(math.exp(a)) <= loss(math.exp(b)) else (a, hi)
    model.temperature = math.exp((lo + hi) / 2)
    return model


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """docs: what may be learnt from, with ``doc_id``, ``text`` and ``lang``."""
    own = docs.where("text is not null and lang is not null").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    sample = training_sample(own, per_language)
    return fit(sample, document_frequency(own)) if sample else None


def decide(model: Model | None, text: str | None) -> tuple[str, float]:
    if model is None or not text or not _LETTER.search(text):
        return "und", 0.0
    x = model.logits(text) / model.temperature
    e = np.exp(x - x.max())
    return model.languages[int(e.argmax())], float(e.max() / e.sum())


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score: the most probable language and its calibrated probability."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [decide(model, t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [x for x, _ in got], "score": np.array([p for _, p in got], dtype=float)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(trimmed(run), "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: Model | None, min_score: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with ``min_score`` or more."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns may have any names
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [decide(model, t) for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array([x != "und" and p >= min_score for x, p in got], type=pa.bool_()))

    own = docs.toDF(*names)
    return own.mapInArrow(trimmed(run), own.schema).toDF(*docs.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(bucket_of("doc_id", 5) != 0))
    return predict(docs, model).select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
