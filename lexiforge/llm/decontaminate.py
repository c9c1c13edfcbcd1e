"""Benchmark decontamination by latent semantic retrieval.

The benchmark is taken in blocks of bounded size. For each, terms are the block's words, weighted by TF-IDF with
document frequencies over all documents; one pass splits all texts for as many blocks as fit GROUP_BYTES (thousands
of items) and stores the numbers of their words, which the passes after it read. A randomised singular value
decomposition, in one pass, of the matrix of passages (the windows of all documents, and the items, weighted as
much) gives the latent space of a block: tasks add up the products of their passages, and only these small
matrices meet. Every window of every document is projected and compared with the items by cosine; candidates are
verified by the longest common subsequence of words with the item in the words around, and, where that alone
leaves doubt as in a paraphrase, by the item's answer, its last line or sentence, which must be there too.

Null or empty texts, and documents without a word of the block, match nothing. Items without a word are left
out; items of fewer than MIN_ITEM words must be there whole. Rows that share a doc_id are judged one by one and
the best match of an id and item is returned once; a null doc_id stays null. An empty table or benchmark gives
an empty result. Only ``doc_id``, ``text``, ``item_id`` are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import bounded, drop, fresh_names, save, table, trimmed

BLOCK_ITEMS = 256
CHUNK, CHUNKS = 16, 3
RANK, OVER = 256, 8
MIN_COSINE = 0.45
MIN_LCS, PARAPHRASE_LCS, MIN_ANSWER = 0.7, 0.5, 0.8
MIN_ITEM = 8
ROWS, FAN = 512, 32
SLICE_WORDS, FLUSH_PASSAGES, STRIPE = 1 << 16, 1 << 18, 128
GRAM_BYTES = 32 << 20
GROUP_BYTES = 128 << 20
_MARKS = b".,;:!?()[]{}\"'*-"


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without the marks in them; words of marks only are left out."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _MARKS).split()


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def answer_of(text: str) -> list[bytes]:
    """Words of the last line, or of the last sentence of a text of one line."""
    lines = [x for x in text.split("\n") if words_of(x)]
    if len(lines) > 1:
        return words_of(lines[-1])
    sentences = [x for x in text.replace("!", ".").replace("?", ".").split(".") if words_of(x)]
    return words_of(sentences[-1]) if sentences else []


class Space:
    """A block of items with its terms and, once fitted, its latent space."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w, answer_of(t)) for i, t in items if (w := words_of(t))]
        self.terms = {w: n for n, w in enumerate(sorted({w for _, own, _ in self.items for w in own}))}
        self.item_ids = [self.ids(w) for _, w, _ in self.items]
        self.answers = [[self.terms.get(w, -3) for w in own] for _, _, own in self.items]  # -3 equals no word of a text
        self.places = np.zeros(0, dtype=np.int64)  # term of each number of a stored word
        self.seen = np.zeros(len(self.terms) + 1, dtype=bool)
        self.idf = np.ones(len(self.terms), dtype=np.float32)
        self.basis = self.targets = np.zeros((len(self.terms), 0), dtype=np.float32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Term of each word, -1 for one that no item has."""
        return np.fromiter(map(self.terms.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def item_rows(self) -> np.ndarray:
        out = np.zeros((len(self.items), len(self.terms)), dtype=np.float32)
        for n, (_, words, _) in enumerate(self.items):
            np.add.at(out[n], self.ids(words), 1)
        out *= self.idf
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def chunk_sums(self, ids: np.ndarray, of_term: np.ndarray) -> np.ndarray:
        """Sum of the rows of of_term for each chunk of CHUNK words."""
        at = np.flatnonzero(ids >= 0)
        out = np.zeros((-(-len(ids) // CHUNK), of_term.shape[1]), dtype=np.float32)
        if len(at):
            chunk = at // CHUNK
            first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            out[chunk[first]] = np.add.reduceat(of_term[ids[at]], first, axis=0)
        return out

    def passages(self, texts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, term, unit TF-IDF weight) of each entry, in this order, of windows that don't overlap; some SLICE_WORDS at once."""
        size, keys, row, n = len(self.terms), [], 0, 0
        for ids in chain(texts, [None]):
            if ids is not None:
                at = np.flatnonzero(ids >= 0)
                keys.append((row + at // (CHUNK * CHUNKS)) * size + ids[at])
                row += -(-len(ids) // (CHUNK * CHUNKS))
                n += len(at)
            if n and (ids is None or n >= SLICE_WORDS):
                key, count = np.unique(np.concatenate(keys), return_counts=True)
                rows, own = np.divmod(key, size)
                weights = count * self.idf[own]
                yield rows, own, (weights / np.sqrt(np.bincount(rows, weights**2))[rows]).astype(np.float32)
                keys, row, n = [], 0, 0

    def search(self, text: str | None) -> list[tuple[int, float, float, float, int, int]]:
        return self.find(self.ids(words_of(text)))

    def find(self, ids: np.ndarray) -> list[tuple[int, float, float, float, int, int]]:
        """(number of the item, cosine, LCS share, answer share, first, last word) of each verified item, the best place of each."""
        if not np.any(ids >= 0):
            return []
        chunks = self.chunk_sums(ids, self.basis)
        size = min(CHUNKS, len(chunks))
        windows = chunks[: len(chunks) - size + 1].copy()
        for i in range(1, size):
            windows += chunks[i : i + len(windows)]
        norm = np.linalg.norm(windows, axis=1)
        cosine = (windows @ self.targets) / np.maximum(norm, 1e-9)[:, None]
        best: dict[int, tuple[int, float, float, float, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for w, n in np.argwhere(cosine >= MIN_COSINE):
            item, answer = self.item_ids[n], self.answers[n]
            a = max(0, w * CHUNK - len(item))
            b = min(len(ids), (w + size) * CHUNK + len(item))
            if (n, a, b) in tried or n in best and best[n][2] >= 1:
                continue
            tried.add((n, a, b))
            self.seen[:] = False
            self.seen[ids[a:b]] = True  # an unknown word, -1, marks the place behind all terms
            if np.count_nonzero(self.seen[item]) < PARAPHRASE_LCS * len(item):
                continue  # the item's words that are there at all bound the subsequence
            around = ids[a:b].tolist()
            share = lcs(item.tolist(), around) / len(item)
            told = lcs(answer, around) / len(answer) if answer else 0.0
            enough = share >= 1 if len(item) < MIN_ITEM else share >= MIN_LCS or share >= PARAPHRASE_LCS and told >= MIN_ANSWER and cosine[w, n] >= 1.4 * MIN_COSINE
            if enough and (n not in best or share > best[n][2]):
                best[int(n)] = (int(n), float(cosine[w, n]), share, told, int(a), int(b) - 1)
        return list(best.values())


def _add_triangle(out: np.ndarray, pairs: np.ndarray, probe: np.ndarray) -> None:
    """Add the product of a symmetric matrix, of which pairs holds the lower triangle by rows, and probe."""
    size = len(probe)
    for a in range(0, size, STRIPE):
        b = min(a + STRIPE, size)
        rows = np.zeros((b - a, b), dtype=np.float32)
        for j in range(a, b):
            rows[j - a, : j + 1] = pairs[j * (j + 1) // 2 : j * (j + 1) // 2 + j + 1]
        out[a:b] += rows @ probe[:b]
        rows[np.arange(b - a), np.arange(a, b)] = 0
        out[:b] += rows.T @ probe[a:b]


def gram_times(passages: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], probe: np.ndarray, limit: int = GRAM_BYTES) -> np.ndarray:
    """A'A probe, where A has the passages as rows.

    A'A is added up pair by pair of terms if its triangle takes no more than ``limit`` bytes; else the passages' products are, which
    gives the same but for rounding and takes some ten times as long.
    """
    size, out = len(probe), np.zeros_like(probe)
    if size * (size + 1) * 2 > limit:
        for rows, terms, weights in passages:
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            for a in range(0, len(first), ROWS):
                b = first[a + ROWS] if a + ROWS < len(first) else len(rows)
                begin, own, weight = first[a : a + ROWS], terms[first[a] : b], weights[first[a] : b, None]
                products = np.repeat(np.add.reduceat(probe[own] * weight, begin - begin[0]), np.diff(begin, append=b), axis=0) * weight
                order = np.argsort(own, kind="stable")
                start = np.flatnonzero(np.diff(own[order], prepend=-1))
                out[own[order][start]] += np.add.reduceat(products[order], start)
        return out
    pairs, held = np.zeros(size * (size + 1) // 2, dtype=np.float32), 0
    for rows, terms, weights in passages:
        begin, at, off = terms * (terms + 1) // 2, np.arange(len(rows)), 0
        while len(at):
            np.add.at(pairs, begin[at + off] + terms[at], weights[at + off] * weights[at])
            off += 1
            at = at[at + off < len(rows)]
            at = at[rows[at + off] == rows[at]]
        held += int(rows[-1]) + 1
        if held >= FLUSH_PASSAGES:  # sums of float32 stay so small that none of what is added is lost
            _add_triangle(out, pairs, probe)
            pairs[:], held = 0, 0
    _add_triangle(out, pairs, probe)
    return out


_PART = "sender long, part long, data binary"


def _sum_matrices(parts: DataFrame, senders: int, rows: int, columns: int, by: int) -> np.ndarray:
    """Sum of float32 matrices that ``senders`` tasks sent in blocks of ``by`` rows, FAN of them at once."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["data"].iloc[0]) // 4, dtype=np.float64)
        for x in pdf["data"]:
            total += np.frombuffer(x, dtype=np.float32)
        return pd.DataFrame({"sender": pdf["sender"][:1] // FAN, "part": pdf["part"][:1], "data": [total.astype(np.float32).tobytes()]})

    while senders > 1:
        parts = parts.groupBy("part", F.floor(F.col("sender") / FAN)).applyInPandas(add, _PART)
        senders = -(-senders // FAN)
    out = np.zeros((rows, columns), dtype=np.float32)
    for r in parts.collect():
        out[r["part"] * by : (r["part"] + 1) * by] += np.frombuffer(bytes(r["data"]), dtype=np.float32).reshape(-1, columns)
    return out


def encoded(docs: DataFrame, spaces: list[Space]) -> tuple[DataFrame, str, type]:
    """Stored: doc_id, th (hash of the text), ids, which number each word of the text by the terms of all spaces, others as their count; type of a number."""
    terms = {w: n for n, w in enumerate(sorted({w for s in spaces for w in s.terms}))}
    size = len(terms)
    kind = np.uint16 if size < 1 << 16 else np.int32
    for space in spaces:
        space.places = np.full(size + 1, -1, dtype=np.int64)
        space.places[[terms[w] for w in space.terms]] = np.arange(len(space.terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = map(words_of, batch.column("text").to_pylist())
            ids = [np.fromiter(map(terms.get, own, repeat(size)), dtype=kind, count=len(own)).tobytes() for own in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(ids, pa.binary())], ["doc_id", "th", "ids"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text"))
    return *save(rows.mapInArrow(trimmed(run), "doc_id long, th long, ids binary"), "words"), kind


def document_frequency(stored: DataFrame, kind: type, size: int) -> tuple[np.ndarray, int, int]:
    """Documents that hold each of ``size`` terms; documents; tasks that read them: over all rows, in one pass."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size + 1, dtype=np.int64)
        held = np.zeros(size + 1, dtype=bool)
        for batch in batches:
            for ids in batch["ids"]:
                held[:] = False
                held[np.frombuffer(ids, dtype=kind)] = True
                held[size] = True
                total += held
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "n": total[at]})

    sent = stored.select("ids").mapInPandas(trimmed(count), "term long, n long")
    got = sent.withColumn("sender", F.spark_partition_id()).groupBy("term").agg(F.sum("n").alias("n"), F.max("sender").alias("sender")).collect()
    out = np.zeros(size + 1, dtype=np.int64)
    for r in got:
        out[r["term"]] = r["n"]
    return out[:size], int(out[size]), max((r["sender"] + 1 for r in got), default=1)


def fit(stored: DataFrame, kind: type, senders: int, space: Space, rank: int = RANK) -> None:
    """The latent space by a randomised singular value decomposition of all documents' passages and the items."""
    size = len(space.terms)
    k = min(rank, size)
    width = min(k + OVER, size)
    probe = np.linalg.qr(np.random.default_rng(7).standard_normal((size, width)))[0].astype(np.float32)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = (space.places[np.frombuffer(ids, dtype=kind)] for batch in batches for ids in batch["ids"])
        out = gram_times(space.passages(texts), probe)
        yield pd.DataFrame({"part": np.arange(-(-size // ROWS)), "data": [out[a : a + ROWS].tobytes() for a in range(0, size, ROWS)]})

    items = space.item_rows()
    sent = stored.select("ids").mapInPandas(trimmed(products), "part long, data binary").select(F.spark_partition_id().cast("long").alias("sender"), "part", "data")
    y = _sum_matrices(sent, senders, size, width, ROWS).astype(np.float64)
    weight = max(1.0, float(np.sum(probe * y)) / max(1e-9, float(np.sum((items @ probe) ** 2))))  # the items weigh as much as the passages
    y += weight * (items.T @ (items @ probe))
    latent = np.linalg.svd(y, full_matrices=False)[0][:, :k].astype(np.float32)
    targets = items @ latent
    space.basis = np.ascontiguousarray(latent * space.idf[:, None]).astype(np.float32)
    space.targets = np.ascontiguousarray((targets / np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-9)).T.astype(np.float32))


_MATCH = "doc_id long, th long, item_id long, cosine double, lcs_share double, answer_share double, first_word long, last_word long"


def _search(stored: DataFrame, kind: type, spaces: list[Space]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = (np.frombuffer(ids, dtype=kind) for ids in batch["ids"])
            rows = [(doc, th, space.items[n][0], *rest) for doc, th, ids in zip(batch["doc_id"], batch["th"], texts, strict=True) for space in spaces for n, *rest in space.find(space.places[ids])]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _MATCH.split(", ")])
            yield out.astype({"doc_id": "Int64"})

    return stored.mapInPandas(trimmed(run), _MATCH)


def matches(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, th (hash of the text), item_id, cosine, lcs_share, answer_share, first_word, last_word (of the words compared).

    The documents are read once for each group of blocks whose spaces have ``group_bytes``; the numbers of their words are
    read once to count, once for each space to fit and once to search.
    """
    spark = docs.sparkSession
    known = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    n_items = known.count()
    found = spark.createDataFrame([], _MATCH)
    blocks, b = -(-n_items // block_items), 0
    while b < blocks:
        spaces: list[Space] = []
        while b < blocks and sum(len(s.terms) for s in spaces) * RANK * 4 < group_bytes:
            rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
            space = Space(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
            spaces += [space] if space.items else []
            b += 1
        if not spaces:
            continue
        stored, path, kind = encoded(docs, spaces)
        df, n_docs, senders = document_frequency(stored, kind, len(spaces[0].places) - 1)
        for space in spaces:
            own = np.zeros(len(space.terms))
            own[space.places[space.places >= 0]] = df[space.places[:-1] >= 0]
            space.idf = (np.log((1 + n_docs) / (1 + own)) + 1).astype(np.float32)
            fit(stored, kind, senders, space)
        found = found.unionByName(save(_search(stored, kind, spaces), "matches")[0])
        drop(spark, path)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share, first_word, last_word (of the words compared): a row per match."""
    best = F.max_by(F.struct("cosine", "lcs_share", "answer_share", "first_word", "last_word"), F.struct("lcs_share", "cosine", "first_word"))
    return matches(docs, benchmark, block_items, group_bytes).groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame, **limits: int) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item; rows are told apart by doc_id, null or not, and text."""
    did, th, none = fresh_names(docs, "did", "th", "none")
    gone, _ = save(matches(docs, benchmark, **limits).select(F.coalesce("doc_id", F.lit(0)).alias(did), F.col("doc_id").isNull().alias(none), F.col("th").alias(th)).distinct(), "contaminated")
    keyed = docs.withColumns({did: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), none: F.col("doc_id").isNull(), th: F.xxhash64(F.col("text").cast("string"))})
    return keyed.join(bounded(gone), [did, none, th], "left_anti").drop(did, th, none)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
