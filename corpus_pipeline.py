"""A corpus-cleaning pipeline made of the training-data operators.

A stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All but the last return the
columns of documents; the last returns the places of the packed pieces. Near-duplicates are dropped by doc_id: rows
that share one count as one document, and rows without one are linked with nothing and stay. Elsewhere each row is
judged by its own text, whatever its id. Null and empty texts have no language and go with the first stage. Further
columns of any name are handed on. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import bounded, bucket_of, drop, fresh_names, save, small_batches, table
from lexiforge.llm.decontaminate import clean
from lexiforge.llm.language import identified, learn
from lexiforge.llm.linededup import dedup_lines
from lexiforge.llm.minmax import near_duplicates
from lexiforge.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told go."""
    small_batches(spark)
    return identified(docs, learn(docs.where(bucket_of("doc_id", 5) != 0)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go from the texts, and documents of which nothing is left."""
    own = {c: fresh_names(docs, c)[0] for c in docs.columns if c.lower() in ("removed_lines", "removed_words")}
    out = dedup_lines(docs.withColumnsRenamed(own)).where((F.col("removed_words") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    length = F.when(F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).drop("removed_lines", "removed_words").withColumnsRenamed({b: a for a, b in own.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    small_batches(spark)
    gone, _ = save(near_duplicates(docs, shingle_words=5, percent=80).where("not kept").select("doc_id").distinct(), "near-duplicates")
    return docs.join(bounded(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    small_batches(spark)
    return pack(docs, str(path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language identification, latent semantic retrieval and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = save(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
