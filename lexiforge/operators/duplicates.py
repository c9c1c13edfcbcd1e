"""Exact duplicates: groups, patterns, survivors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_LENGTH = 10


def _hashed(rows: DataFrame, least: int) -> DataFrame:
    return rows.where(F.length(F.trim("text")) >= least).select("id", F.coalesce("author", F.lit("nan")).alias("author"), F.coalesce("date", F.lit("nan")).alias("date"), F.coalesce("source", F.lit("nan")).alias("source"), F.md5("text").alias("hash"))


def duplicate_ids(rows: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """(id, source, hash) of all but the first of each group of equal texts, by (date, id, author, source).

    The first of a group is found by an aggregate with map-side combination, so a group of any size is no hot task.
    """
    own = _hashed(rows, least)
    first = own.groupBy("hash").agg(F.min(F.struct("date", "id", "author", "source")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = own.join(first.select("hash", "first"), "hash").where(F.struct("date", "id", "author", "source") > F.col("first"))
    return later.select("id", "source", "hash")


def duplicate_groups(rows: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """(hash, count, pattern, authors, sources) of groups of two rows or more; sets are sorted."""
    own = _hashed(rows, least)
    many = own.groupBy("hash").agg(F.count("*").alias("count")).where("count > 1")
    # Only rows of groups are listed, and each author and source of a group once before the lists are made.
    listed = lambda c: own.select("hash", c).distinct().join(many.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.array_sort(F.collect_list(c)).alias(f"{c}s"))
    grouped = many.join(listed("author"), "hash").join(listed("source"), "hash")
    author = F.when(F.size("authors") == 1, "same_author").otherwise("different_author")
    source = F.when(F.size("sources") == 1, "same_source").otherwise("different_source")
    return grouped.select("hash", "count", F.concat_ws("_", author, source).alias("pattern"), "authors", "sources")


def duplicate_stats(rows: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    per = _hashed(rows, least).groupBy("hash").agg(F.count("*").alias("n"))
    total, dup = F.sum("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    rate = F.when(total > 0, F.round(dup.cast("double") / total * F.lit(100.0).cast("double"), 2)).otherwise(F.lit(0.0).cast("double"))
    return per.agg(total.alias("n_rows"), F.count("*").alias("unique_hashes"), F.count_if(F.col("n") > 1).alias("groups"), dup.alias("total_duplicates"), rate.alias("duplicate_rate"))


def mark_duplicates(rows: DataFrame, ids: DataFrame, by_id_only: bool = False) -> DataFrame:
    """rows with is_dup; rows are told apart by (source, id), or by id alone."""
    key = ["id"] if by_id_only else ["id", "source"]
    return rows.join(ids.select(*key).distinct().withColumn("is_dup", F.lit(True)), key, "left").withColumn("is_dup", F.coalesce("is_dup", F.lit(False)))


def drop_duplicates(rows: DataFrame, ids: DataFrame, by_id_only: bool = False) -> DataFrame:
    key = ["id"] if by_id_only else ["id", "source"]
    return rows.join(ids.select(*key), key, "left_anti")


def survivors(rows: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """(hash, id) that stays of each group, by the same order."""
    order = W.partitionBy("hash").orderBy("date", "id", "author", "source")
    return _hashed(rows, least).withColumn("rank", F.row_number().over(order)).where("rank = 1").select("hash", "id")
