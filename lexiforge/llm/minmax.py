"""Near-duplicate groups by min-max hashing.

Each random permutation of the shingles is evaluated once and gives two values of a signature, its minimum and
its maximum; the share of equal values estimates the Jaccard similarity without bias. A band is two
permutations, so four values; with 32 bands a pair at the threshold of 0.8 is missed with probability 5e-8.

Documents with equal sets form a class first, so copies cost one row each. Of every bucket of a band, all
members are compared with its hub, the member that shares most buckets with others. Where that leaves a bucket
in more than one component, small buckets compare all members that are still apart, and the members of large
ones meet by an exact prefix filter: sets of similarity t share one of their (1 - t) n + 1 rarest shingles.
All links are confirmed on full sets.

Null or empty text, or one without words: an empty set, linked with nothing. Rows that share a doc_id are one
vertex. A null doc_id: linked with nothing, component_id null, kept. An empty table gives an empty result. Only
``doc_id`` and ``text`` are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import bounded, drop, join_by_key, save, table, trimmed
from lexiforge.llm.components import components
from lexiforge.llm.words import Hashes, mix, shingles, words_of

BANDS, PERMUTATIONS_PER_BAND = 32, 2
SMALL_BUCKET = 16
GROUP = 128
FREQUENT = 200_000


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n, None] | np.uint64(1), seeds[n:, None]


def signature(found: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(2, permutations): minima and maxima; found: a set that isn't empty."""
    a, b = _permutations(bands * PERMUTATIONS_PER_BAND)
    low = high = None
    for start in range(0, len(found), 4096):
        values = found[None, start : start + 4096] * a + b
        lo, hi = values.min(axis=1), values.max(axis=1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return np.stack([low, high])


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    out = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for row in sig:
        for j in range(PERMUTATIONS_PER_BAND):
            out = mix(out + row[j::PERMUTATIONS_PER_BAND])
    return out.view(np.int64)


def _sets(size: int, cache: Hashes, text: str | None) -> np.ndarray:
    return np.unique(shingles(cache.of(words_of(text)), size))


def sketches(docs: DataFrame, size: int, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, a digest of the set, band keys (null for an empty set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for batch in batches:
            n, digests, keys = [], [], []
            for text in batch["text"]:
                found = _sets(size, cache, text)
                n.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(band_keys(signature(found, bands), bands) if len(found) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": np.array(n, dtype=np.int64), "digest": digests, "bands": keys})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(trimmed(run), "doc_id long, n_shingles long, digest binary, bands array<long>")


def _confirm(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs(hub, b) whose full sets reach the similarity.

    Every text that a pair needs is hashed once; a hub's members are dealt out in groups of about GROUP, each with
    the hub's set, so a hub with any number of members is no hot key.
    """
    spark = pairs.sparkSession
    per_hub = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    dealt = join_by_key(pairs, per_hub, ["hub"]).select("hub", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / GROUP)).alias("part"))
    members = dealt.select(F.col("b").alias("doc_id"), "hub", "part", F.lit(False).alias("is_hub"))
    hubs = dealt.select("hub", "part").distinct().select(F.col("hub").alias("doc_id"), "hub", "part", F.lit(True).alias("is_hub"))
    use, slot = F.struct("hub", "part", "is_hub"), F.floor(F.col("part") / GROUP)
    wanted = members.unionByName(hubs).groupBy("doc_id", slot.alias("slot")).agg(F.collect_list(use).alias("uses"))
    wanted, path = save(wanted, "wanted")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(bounded(wanted, weight=F.size("uses")), "doc_id")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, names = Hashes(), ["hub", "part", "is_hub", "b", "found"]
        for batch in batches:
            rows, held = [], 0
            for doc, text, uses in zip(batch["doc_id"], batch["text"], batch["uses"], strict=True):
                packed = _sets(size, cache, text).tobytes()
                for u in uses:
                    rows.append((u["hub"], u["part"], u["is_hub"], doc, packed))
                    held += len(packed)
                    if held > 1 << 24:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, hub_sets = None, []
        for batch in batches:
            rows = []
            for hub, part, is_hub, b, found in batch.itertuples(index=False):
                own = np.frombuffer(found, dtype=np.uint64)
                if at != (hub, part):
                    at, hub_sets = (hub, part), []
                if is_hub:
                    hub_sets.append(own)
                    continue
                for other in hub_sets:
                    if 100 * min(len(own), len(other)) >= percent * max(len(own), len(other)):
                        shared = len(own) + len(other) - len(np.union1d(own, other))
                        if 100 * shared >= percent * (len(own) + len(other) - shared):
                            rows.append((hub, b))
                            break
            yield pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    sent = texts.mapInPandas(trimmed(emit), "hub long, part long, is_hub boolean, b long, found binary")
    meet = sent.repartition("hub", "part").sortWithinPartitions("hub", "part", F.desc("is_hub"))
    links, _ = save(meet.mapInPandas(trimmed(check), "a long, b long").distinct(), "confirmed")
    drop(spark, path)
    return links


def _similar_size(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _by_prefix(docs: DataFrame, ids: DataFrame, size: int, percent: int, frequent: int = FREQUENT) -> tuple[DataFrame, list[str]]:
    """Pairs(hub, b) of ids(rep, component) of different components that share a rare shingle of their prefixes, and the tables they are read from.

    Any one order of the shingles gives a right prefix filter. Here it is by rising number of sets that hold them, which
    is known for the most frequent ones, at most ``frequent``; the others come before these, by hash.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string")).join(bounded(ids), "rep")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for batch in batches:
            s, n = np.unique(np.concatenate([_sets(size, cache, t) for t in batch["text"]]), return_counts=True)
            yield pd.DataFrame({"s": s.view(np.int64), "n": n})

    counted, counted_path = save(texts.select("text").mapInPandas(trimmed(count), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")), "counted")
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = counted.where(F.col("n") > max(1, total // frequent)).collect()  # fewer than ``frequent`` rows
    known = np.array(sorted((r["s"], r["n"]) for r in often), dtype=np.int64).reshape(-1, 2)
    drop(docs.sparkSession, counted_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for batch in batches:
            out = []
            for rep, component, text in zip(batch["rep"], batch["component"], batch["text"], strict=True):
                found = _sets(size, cache, text).view(np.int64)
                place = np.minimum(np.searchsorted(known[:, 0], found), max(0, len(known) - 1))
                n = np.where(known[place, 0] == found, known[place, 1], 0) if len(known) else np.zeros(len(found), dtype=np.int64)
                prefix = found[np.lexsort((found, n))][: len(found) - -(-len(found) * percent // 100) + 1]
                out.append(pd.DataFrame({"rep": rep, "component": component, "n": len(found), "at": np.arange(len(prefix)), "s": prefix}))
            yield pd.concat(out)

    cut, cut_path = save(texts.mapInPandas(trimmed(run), "rep long, component long, n long, at long, s long"), "prefixes")
    # Shingles of a single component link nothing that isn't linked.
    across, across_path = save(cut.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("s", F.col("m").alias("n")), "across")
    cut = join_by_key(cut.withColumnRenamed("n", "size"), across, ["s"]).drop("n").withColumnRenamed("size", "n")
    # The smaller set of a pair must meet the other one in a shorter prefix still, and what follows a shared place bounds the overlap.
    least = F.ceil(F.col("n") * (2 * percent) / (100 + percent))
    small = cut.where(F.col("at") <= F.col("n") - least)
    other = cut.select(F.col("rep").alias("b"), F.col("component").alias("other"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), "s")
    needed = (F.col("n") + F.col("n_b")) * percent / (100 + percent)
    room = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")) >= needed
    apart = (F.struct("n", "rep") < F.struct("n_b", "b")) & (F.col("component") != F.col("other"))
    near = small.join(other, (small["s"] == other["s"]) & apart & room & _similar_size("n", "n_b", percent))
    return near.select(F.least("rep", "b").alias("hub"), F.greatest("rep", "b").alias("b")).distinct(), [cut_path, across_path]


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of docs; links need ``percent`` of the union shared."""
    spark = docs.sparkSession
    sketch, _ = save(sketches(docs, shingle_words, bands), "sketches")
    linked = sketch.where("digest is not null and doc_id is not null")
    classes, classes_path = save(linked.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")

    whole = linked.withColumnRenamed("n_shingles", "size").select("doc_id", "digest", "size", "bands")
    firsts = join_by_key(whole, classes, ["digest"]).where("doc_id = rep").select("rep", "size", F.explode("bands").alias("key")).distinct()
    met, met_path = save(firsts.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key", "n"), "met")
    members, members_path = save(join_by_key(firsts, met, ["key"]).select("key", "rep", F.col("size").alias("n"), F.col("n").alias("m")), "members")

    weight = members.groupBy("rep").agg(F.sum("m").alias("weight"))
    central = F.min_by(F.struct(F.col("rep").alias("hub"), F.col("n").alias("n_hub")), F.struct(-F.col("weight"), F.col("rep")))
    hubs, hubs_path = save(members.join(weight, "rep").groupBy("key").agg(central.alias("x"), F.count("*").alias("n")).select("key", "n", "x.*"), "hubs")
    stars = join_by_key(members.withColumnRenamed("n", "size"), hubs, ["key"]).where("rep <> hub").where(_similar_size("size", "n_hub", percent))
    stars, stars_path = save(stars.select("hub", F.col("rep").alias("b")).distinct(), "stars")
    links = _confirm(docs, stars, shingle_words, percent)

    # Rows that share an id and differ in their sets are one vertex.
    several = linked.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("doc_id")
    of_id = linked.select("doc_id", "digest").join(bounded(several), "doc_id").distinct().join(classes, "digest").select("doc_id", "rep")
    one_id = of_id.join(of_id.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("rep <> a")
    links = links.unionByName(one_id.select("a", F.col("rep").alias("b")))
    found = components(links)

    label = members.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split, split_path = save(label.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", F.col("n").alias("n")), "split")
    apart = join_by_key(label.withColumnRenamed("n", "size"), split, ["key"]).select("key", "rep", "component", F.col("size").alias("n"), "m")
    apart, apart_path = save(apart, "apart")
    small = apart.where(F.col("m") <= SMALL_BUCKET)
    other = small.select("key", F.col("rep").alias("b"), F.col("component").alias("other"), F.col("n").alias("n_b"))
    near = small.join(other, "key").where("rep < b and component <> other").where(_similar_size("n", "n_b", percent))
    pairs = near.select(F.col("rep").alias("hub"), "b").distinct()
    large, prefix_paths = apart.where(F.col("m") > SMALL_BUCKET).select("rep", "component").distinct(), []
    if large.limit(1).count():
        by_prefix, prefix_paths = _by_prefix(docs, large, shingle_words, percent)
        pairs = pairs.unionByName(by_prefix).distinct()
    tested = stars.select(F.least("hub", "b").alias("hub"), F.greatest("hub", "b").alias("b"))
    pairs, pairs_path = save(pairs.join(tested, ["hub", "b"], "left_anti"), "pairs")
    if pairs.limit(1).count():
        more = _confirm(docs, pairs, shingle_words, percent)
        if more.limit(1).count():
            found = components(links.unionByName(more))

    # Components meet classes, one row each; then copies meet their class.
    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("digest", "n", F.coalesce("component", "rep").alias("component"))
    named, _ = save(named, "named")
    drop(spark, classes_path, met_path, members_path, hubs_path, stars_path, split_path, apart_path, pairs_path, *prefix_paths)
    own = join_by_key(linked.select("doc_id", "n_shingles", "digest"), named, ["digest"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = sketch.where("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


# All pairs of documents that share a shingle, exactly counted, and all that links reach.
OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), sized AS (
  SELECT * FROM shingles JOIN sizes USING (doc_id)
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared WHERE 100 * c >= 80 * (n + m - c)
), reach AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT b, c FROM reach JOIN links ON reach.doc_id = a
), component AS (
  SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN component USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
