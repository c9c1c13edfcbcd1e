"""Language-model scoring with an Elias-Fano n-gram trie.

Learning and scoring are two jobs. Learning counts words and pairs of neighbours of the training texts: tasks add up
what about BLOCK_BYTES of text hold and send each shard, a range of word hashes, its words with their successors as
Elias-Fano sequences. A shard adds up what it gets, smooths, quantises and stores its part of the trie, a row of a
table in the shared folder: words (by hash), monotone pointers to the successors of each, the successors relative to
their context, quantised probabilities. The table is the model; any texts can be scored with it. It grows with the
input, and no task or broadcast holds all of it.

Scoring deals documents to blocks by a hash. A block asks the shards for its distinct words and pairs, whether they
were ever learnt or not; a shard maps its levels from a scratch folder, looks for each word and, between the pointers
of the word, for the successors, and sends back codes, a byte each, and the words' counts.

Pairs are smoothed by interpolated absolute discounting: p(v | u) = max(c(u, v) - D, 0) / c(u) + D n(u) / c(u) p(v),
n(u) the number of different successors, p(v) = (c(v) + 1) / (N + V + 1) the base model; the first word, and one
after a word that isn't known, have p(v). The first term and the factor of the second are what is stored, on a
logarithmic scale of 254 steps (each within 2 percent). Words are told apart by 64 bits of hash, the successors of a
context by 32. Triples are left out: see the README.

A word with more than its share of all tokens, an average shard's worth by a sample, would make its shard a hot one. Its
successors are dealt by their hash to several stand-ins of the word, each at a place of its own; the sums of the
stand-ins are put together on the driver (a few for each shard at most), so results are those of one context.

Null or empty text: the end token only. A null doc_id counts as empty text where the fold is chosen. Repeated
rows are scored, and learnt from, as often as they occur. Without training texts N and V are 0 and every score
is 0. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so further columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import bucket_of, parts_for, save, table, text_bytes, trimmed
from lexiforge.llm.eliasfano import EliasFano, Trie, joined, parted, scratch
from lexiforge.llm.words import Hashes, mix, words_of

DISCOUNT = 0.75
BLOCK_BYTES, SHARD_BYTES = 12 << 20, 24 << 20
END = b" "  # no word holds a space
LEAST, STEPS = 9.0, 254  # decades that the quantised probabilities span
_SUCCESSOR = np.uint64((1 << 32) - 1)
_STAND_IN = np.uint64(0x9E3779B97F4A7C15)


def quantise(p: np.ndarray) -> np.ndarray:
    """1 to 255 for probabilities from 1e-9 to 1, by their logarithm."""
    return (1 + np.clip(np.rint((np.log10(p) / LEAST + 1) * STEPS), 0, STEPS)).astype(np.uint8)


_VALUES = np.concatenate([[0.0], 10.0 ** (LEAST * (np.arange(STEPS + 1) / STEPS - 1))])


def dequantise(codes: np.ndarray) -> np.ndarray:
    """0 for the code 0, of what isn't there."""
    return _VALUES[codes]


@dataclass
class Model:
    """A stored table of shards with what all tasks need to know of it."""

    levels: DataFrame
    path: str
    shards: int
    n: int  # training tokens
    v: int  # different ones
    hot: np.ndarray  # hashes of the words with stand-ins, sorted
    copies: np.ndarray  # stand-ins of each
    backoff: np.ndarray  # factor of the base model after each of these words
    shares: dict[int, float]  # stand-in to its share of the word's tokens


class Grams:
    """Distinct words, stand-ins and pairs of some texts, in order, and where each token finds its own."""

    def __init__(self, texts: list[str], cache: Hashes, hot: np.ndarray, copies: np.ndarray, places: bool = False):
        """places: whether each token's own pair is looked for too (``pair_of``)."""
        found = [np.append(cache.of(words_of(t)), np.uint64(cache[END])) for t in texts]
        tokens = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
        self.text = np.repeat(np.arange(len(found)), [len(x) for x in found])
        self.second = np.flatnonzero(self.text[1:] == self.text[:-1]) + 1
        own, n = tokens[self.second], len(tokens)
        self.hot_at, self.which_hot = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if len(hot):
            context = tokens[self.second - 1]
            which = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
            self.hot_at = np.flatnonzero(hot[which] == context)
            self.which_hot = which[self.hot_at]
            nth = (own[self.hot_at] >> np.uint64(32)) % copies[self.which_hot].astype(np.uint64) + np.uint64(1)
            tokens = np.concatenate([tokens, mix(context[self.hot_at] + nth * _STAND_IN)])
        self.words, at = np.unique(tokens, return_inverse=True)
        self.word_of = at[:n]
        self.context_of = self.word_of[self.second - 1]
        self.context_of[self.hot_at] = at[n:]
        pairs = (self.context_of.astype(np.uint64) << np.uint64(32)) | (own & _SUCCESSOR)
        if places:
            self.pairs, self.pair_of = np.unique(pairs, return_inverse=True)
        else:
            self.pairs, self.pair_counts = np.unique(pairs, return_counts=True)
        self.counts = np.bincount(self.word_of, minlength=len(self.words))  # of stand-ins: 0

    def messages(self, shards: int, with_counts: bool) -> Iterator[tuple[int, bytes]]:
        """(shard, its words and their successors), for each shard that has some."""
        shard = (self.words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        owner = (self.pairs >> np.uint64(32)).astype(np.int64)
        successors = np.bincount(owner, minlength=len(self.words)).astype("<u4")
        starts = np.concatenate([[0], np.cumsum(successors, dtype=np.int64)])
        pack = lambda x: zlib.compress(x.astype("<u4").tobytes(), 1)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard)) if len(shard) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s, x, y = int(shard[a]), starts[a], starts[b]
            least = _least(s, shards)
            relative = self.pairs[x:y] - (np.uint64(a) << np.uint64(32))
            parts = [EliasFano.encode(self.words[a:b] - np.uint64(least), _least(s + 1, shards) - least).pack(), pack(successors[a:b]), EliasFano.encode(relative, int(b - a) << 32).pack()]
            if with_counts:
                parts += [pack(self.counts[a:b]), pack(self.pair_counts[x:y])]
            yield s, joined(parts)


def _least(shard: int, shards: int) -> int:
    """The least hash of a shard."""
    return -(-(shard << 32) // shards) << 32


def _opened(raw: bytes, shard: int, shards: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words, pairs and, if there, counts of both of a message."""
    words, _, pairs, *counts = parted(raw)
    own = EliasFano.unpack(words).all() + np.uint64(_least(shard, shards))
    return own, EliasFano.unpack(pairs).all(), [np.frombuffer(zlib.decompress(c), dtype="<u4") for c in counts]


def _blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[list[str]]:
    """Texts of about ``size`` characters at a time."""
    held, n = [], 0
    for batch in batches:
        for text in batch["text"]:
            held.append(text or "")
            n += len(held[-1])
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def hot_words(docs: DataFrame, shards: int, least: int = 1000, sample: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that have an average shard's tokens or more, and their numbers of stand-ins.

    They are looked for in one of ``sample`` documents, by hash: what stands for what balances the shards, and doesn't
    change a score. A task sends the words that are at least ``least`` and a 2 * shards-th of its tokens, so few rows
    whatever the text.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for texts in _blocks(batches, BLOCK_BYTES):
            tokens = np.concatenate([cache.of(words_of(t)) for t in texts])
            found, n = np.unique(tokens, return_counts=True)
            often = n >= max(least, (len(tokens) + len(texts)) / (2 * shards))
            own = [np.append(found[often], [np.uint64(0), np.uint64(cache[END])]).view(np.int64), np.append(n[often], [len(tokens) + len(texts), len(texts)])]
            yield pd.DataFrame({"h": own[0], "n": own[1]})

    some = docs.where(F.pmod(F.xxhash64("text", F.lit(8)), F.lit(sample)) == 0)
    rows = some.select(F.col("text").cast("string")).mapInPandas(trimmed(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows, _ = save(rows, "often")
    total = rows.where("h = 0").agg(F.sum("n").alias("n")).first()["n"] or 0
    often = rows.where("h <> 0").where(F.col("n") * shards > total).collect()  # at most shards rows
    found = sorted((r["h"] % (1 << 64), 2 * r["n"] * shards // total + 1) for r in often)
    return np.array([h for h, _ in found], dtype=np.uint64), np.array([k for _, k in found], dtype=np.int64)


def train(docs: DataFrame, shards: int | None = None, least: int = 1000, sample: int = 64) -> Model:
    """The model of all texts of docs; least, sample: of ``hot_words``."""
    shards = shards or parts_for(docs.sparkSession, text_bytes(docs), SHARD_BYTES)
    hot, copies = hot_words(docs, shards, least, sample)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for texts in _blocks(batches, BLOCK_BYTES):
            rows = list(Grams(texts, cache, hot, copies).messages(shards, True))
            yield pd.DataFrame(rows, columns=["shard", "sent"])

    def build(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        opened = [_opened(x, int(key[0]), shards) for x in batch.pop("sent")]
        words, place = np.unique(np.concatenate([w for w, _, _ in opened]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([c[0] for _, _, c in opened]), minlength=len(words)).astype(np.int64)
        bounds = np.cumsum([0, *(len(w) for w, _, _ in opened)])
        pairs = np.concatenate([place[b:][(p >> np.uint64(32)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | p & _SUCCESSOR for b, (_, p, _) in zip(bounds, opened, strict=False)])
        weights = np.concatenate([c[1] for _, _, c in opened])
        del opened
        pairs, which = np.unique(pairs, return_inverse=True)
        times = np.bincount(which, weights=weights, minlength=len(pairs))
        owner = (pairs >> np.uint64(32)).astype(np.int64)
        total, kinds = np.bincount(owner, weights=times, minlength=len(words)), np.bincount(owner, minlength=len(words))
        backoff = np.where(total > 0, quantise(DISCOUNT * np.maximum(kinds, 1) / np.maximum(total, 1)), 0)
        trie = Trie.build(words, counts, backoff, pairs, quantise((times - DISCOUNT) / total[owner]))
        stand_ins = np.flatnonzero((counts == 0) & (total > 0))
        rows = [(words[i].astype(np.int64), int(total[i]), int(kinds[i])) for i in stand_ins]
        return pd.DataFrame({"shard": [key[0]], "n": [counts.sum()], "v": [np.count_nonzero(counts)], "hot": [[{"h": h, "n": n, "kinds": k} for h, n, k in rows]], "levels": [trie.pack()]})

    sent = docs.select(F.col("text").cast("string")).mapInPandas(trimmed(send), "shard long, sent binary")
    levels, path = save(sent.groupBy("shard").applyInPandas(build, "shard long, n long, v long, hot array<struct<h:long,n:long,kinds:long>>, levels binary"), "model")
    sums = levels.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    of_stand_in = {r["h"] % (1 << 64): (r["n"], r["kinds"]) for r in levels.select(F.inline("hot")).collect()}  # about two a shard
    backoff, shares = np.zeros(len(hot)), {}
    for i, (word, k) in enumerate(zip(hot, copies, strict=True)):
        own = mix(word + np.arange(1, k + 1, dtype=np.uint64) * _STAND_IN).tolist()
        n, kinds = (sum(of_stand_in.get(h, (0, 0))[j] for h in own) for j in (0, 1))
        backoff[i] = DISCOUNT * kinds / n if n else 0.0
        shares |= {h: of_stand_in[h][0] / n for h in own if h in of_stand_in}
    return Model(levels.select("shard", "levels"), path, shards, int(sums["n"] or 0), int(sums["v"] or 0), hot, copies, backoff, shares)


def blocks_of(docs: DataFrame, held_out: Column, blocks: int) -> DataFrame:
    """block, packed: whole texts of the block with their ids, some at a time."""

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for block, own in batch.groupby("block"):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in own["text"]]
                none = own["doc_id"].isna()
                meta = np.stack([own["doc_id"].astype("Int64").fillna(0).to_numpy(dtype="<i8"), none.to_numpy(dtype="<i8"), own["held_out"].to_numpy(dtype="<i8"), np.array([len(t) for t in texts], dtype="<i8")])
                rows.append((block, writer.compress(joined([meta.tobytes(), b"".join(texts)]))))
            yield pd.DataFrame(rows, columns=["block", "packed"])

    # The id goes as text: a column with nulls would come as floating point.
    own = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), F.col("doc_id").cast("long").cast("string").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string"))
    return own.mapInPandas(trimmed(squeeze), "block long, packed binary")


def _unpacked(packed: pd.Series) -> tuple[np.ndarray, list[str]]:
    """(ids, null ids, held out) and texts of a block, in an order that doesn't depend on how its rows came."""
    reader, metas, texts = zstandard.ZstdDecompressor(), [], []
    for raw in packed:
        meta, whole = parted(reader.decompress(raw))
        meta = np.frombuffer(meta, dtype="<i8").reshape(4, -1)
        metas.append(meta)
        ends = np.cumsum(meta[3])
        texts += [str(whole[e - n : e], "utf-8", "surrogatepass") for e, n in zip(ends, meta[3], strict=True)]
    return np.concatenate(metas, axis=1)[:3], texts


def score(docs: DataFrame, held_out: Column, model: Model, blocks: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    blocks = blocks or max(1, -(-text_bytes(docs) // BLOCK_BYTES))
    dealt = blocks_of(docs, held_out, blocks)
    shards, n, v, hot, copies, backoff, shares = model.shards, model.n, model.v, model.hot, model.copies, model.backoff, model.shares

    def ask(batch: pd.DataFrame) -> pd.DataFrame:
        rows = [(batch["block"].iloc[0], s, x) for s, x in Grams(_unpacked(batch["packed"])[1], Hashes(), hot, copies).messages(shards, False)]
        return pd.DataFrame(rows, columns=["block", "shard", "asked"])

    def answer(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        with scratch() as folder:
            trie = Trie.mapped(right["levels"].iloc[0], folder) if len(right) else None
            for block, raw in zip(left["block"], left["asked"], strict=True):
                words, pairs, _ = _opened(raw, int(key[0]), shards)
                counts, factors, codes = np.zeros(len(words), dtype="<i8"), np.zeros(len(words), dtype=np.uint8), np.zeros(len(pairs), dtype=np.uint8)
                if trie is not None:
                    r, known = trie.find_words(words)
                    counts[known], factors[known] = trie.counts[r[known]], trie.backoff[r[known]]
                    owner = (pairs >> np.uint64(32)).astype(np.int64)
                    at = np.flatnonzero(known[owner])
                    codes[at] = trie.find_pairs(r[owner[at]], pairs[at] & _SUCCESSOR)
                rows.append((block, key[0], joined([zlib.compress(x.tobytes(), 1) for x in (counts, factors, codes)])))
            del trie
        return pd.DataFrame(rows, columns=["block", "shard", "found"])

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def final(_key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c: [] for c in names})
        (ids, none, held), texts = _unpacked(left["packed"])
        grams = Grams(texts, Hashes(), hot, copies, places=True)
        parts = [[zlib.decompress(x) for x in parted(raw)] for raw in right.sort_values("shard")["found"]]
        counts, factors, codes = (np.frombuffer(b"".join(p[k] for p in parts), dtype=t) for k, t in enumerate(("<i8", np.uint8, np.uint8)))
        if len(counts) != len(grams.words) or len(codes) != len(grams.pairs):
            raise RuntimeError("a block has lost answers")
        count = counts[grams.word_of].astype(float)
        base = (count + 1) / (n + v + 1)
        p = base.copy()
        at, context = grams.second, grams.context_of
        first, factor = dequantise(codes[grams.pair_of]), dequantise(factors[context])
        if len(hot):
            first[grams.hot_at] *= np.array([shares.get(h, 0.0) for h in grams.words[context[grams.hot_at]].tolist()])
            factor[grams.hot_at] = backoff[grams.which_hot]
        learnt = factor > 0
        p[at[learnt]] = np.minimum(1.0, first[learnt] + factor[learnt] * base[at[learnt]])
        add = lambda x: np.bincount(grams.text, weights=x, minlength=len(texts))
        doc_id = pd.array(ids, dtype="Int64")
        doc_id[none.astype(bool)] = pd.NA
        return pd.DataFrame({"doc_id": doc_id, "held_out": held.astype(bool), "n_tokens": add(np.ones(len(p))).astype(int), "n_known": add(count > 0).astype(int), "train_tokens": n, "base_score": add(np.log10(base)), "score": add(np.log10(p))})

    asked = dealt.groupBy("block").applyInPandas(ask, "block long, shard long, asked binary")
    answers = asked.groupBy("shard").cogroup(model.levels.groupBy("shard")).applyInPandas(answer, "block long, shard long, found binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(final, schema)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of("doc_id", 7) == 2
    return score(docs, held_out, train(docs.where(~held_out)))
