"""The corpus as the operators see it, from a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.text import tokens
from lexiforge.operators.counts import document_frequency
from lexiforge.operators.duplicates import duplicate_ids, mark_duplicates
from lexiforge.operators.vocabulary import union_vocabulary


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, author, date, source, text, tokens); author and date are derived from the id."""
    docs = read(spark, sf_dir, "documents")
    date = F.make_date((2010 + F.col("doc_id") % 10).cast("int"), (1 + F.col("doc_id") % 12).cast("int"), F.lit(1)).cast("string")
    return docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), (F.col("doc_id") % 37).cast("string")).alias("author"), date.alias("date"), "source", "text", tokens(F.col("text")).alias("tokens"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_vocabulary(read(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("token")))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    return mark_duplicates(rows, duplicate_ids(rows))


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row has a token once before rows meet the ids of later copies, which deals them by a shuffle."""
    rows = corpus(spark, sf_dir)
    return document_frequency(mark_duplicates(rows.withColumn("tokens", F.array_distinct("tokens")), duplicate_ids(rows)))
