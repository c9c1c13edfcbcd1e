"""Best-fit packing by minimum bin slack.

Every document becomes its token ids and one separator; documents longer than a sequence are cut. Only the
number of pieces of each length, at most ``capacity`` rows, goes to the driver. There, bin after bin, a bitset
subset-sum dynamic programme over the lengths that are left finds the fullest combination that holds the
longest piece; the same combination is taken as often as its lengths last, so the number of steps depends on
the number of lengths and not on the corpus. Pieces then find their place by their rank among the pieces of
their length: a rank inside the task that made them plus the pieces of earlier tasks.

Null or empty text: one piece, the separator. Repeated rows are packed as often as they occur. An empty table
gives an empty result. Only ``doc_id`` and ``text`` are read, so further columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.llm.common import save, table, trimmed
from lexiforge.llm.tokens import encoder

CAPACITY = 2048
SEPARATOR = 0

Pattern = tuple[tuple[tuple[int, int], ...], int]


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of the fullest combination of at most ``room``; lengths: descending, all in counts."""
    bits, mask, taken = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        left, step = min(counts[length], room // length), 1
        while left > 0 and not bits >> room & 1:
            step = min(step, left)
            grown = bits | (bits << length * step) & mask
            if grown != bits:
                taken.append((length, step, bits))
                bits = grown
            left, step = left - step, step * 2
        if bits >> room & 1:
            break
    at, found = bits.bit_length() - 1, {}
    for length, step, before in reversed(taken):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + step
            at -= length * step
    return sorted(found.items(), reverse=True)


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Combinations ((length, copies), ...) and how many bins take each; every piece is in exactly one."""
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left, reverse=True)
    patterns: list[Pattern] = []
    while lengths:
        seed = lengths[0]
        left[seed] -= 1
        pattern = dict(fullest(left, lengths, capacity - seed))
        left[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        lengths = [k for k in lengths if k in left]
        patterns.append((tuple(sorted(pattern.items(), reverse=True)), times))
    return patterns


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """One row per length in a combination: which ranks of that length it takes, and where they go."""
    rows, used, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in pattern:
            first = used.get(length, 0)
            rows.append((length << 48 | first, copies, sequence, offset))
            used[length] = first + copies * times
            offset += length * copies
        sequence += times
    rows.sort()
    return dict(zip(("key", "copies", "sequence", "offset"), np.array(rows or np.empty((0, 4)), dtype=np.int64).T, strict=True))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all but the first are full."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece, with the task that made it and its rank there among the pieces of its length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        tail = np.array([SEPARATOR], dtype="<u4")
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.concatenate([bpe.encode(text or ""), tail])
                for i, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((doc, i, start, length, zlib.crc32(own.tobytes()), task, seen[length], *([own.astype(np.int32)] if with_ids else [])))
                    seen[length] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *(["ids"] if with_ids else [])])
            yield out.astype({"doc_id": "Int64", "piece": "int32"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(trimmed(run), schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, on request), a row per piece."""
    pieces, _ = save(pieces_of(docs, tokenizer, capacity, with_ids), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = slots(minimum_bin_slack(counts, capacity))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = per_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), (batch["nth"] + batch["before"]).to_numpy()
            at = np.searchsorted(found["key"], length << 48 | rank, side="right") - 1
            within = rank - (found["key"][at] & (1 << 48) - 1)
            out = batch.drop(columns=["task", "nth", "before"])
            out["sequence_id"] = found["sequence"][at] + within // found["copies"][at]
            out["offset"] = found["offset"][at] + within % found["copies"][at] * length
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    joined = pieces.join(before, ["length", "task"])
    order = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "task", "nth", "before"]
    return joined.select(*order).mapInPandas(place, schema)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack(table(spark, sf_dir, "documents"), str(path("byte_bpe_50k.json")))
