"""Term and document frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_day_counts(rows: DataFrame) -> DataFrame:
    """rows(date, tokens) to (token, date, n): every occurrence counts; rows without a date are left out."""
    return rows.where("date is not null").select("date", F.explode("tokens").alias("token")).groupBy("token", "date").agg(F.count("*").alias("n"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Sum of (token, date, n) tables."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("token", "date").agg(F.sum("n").alias("n"))


def token_rollup(counts: DataFrame) -> DataFrame:
    """(token, date, n) to (token, counts map<date, n>, total)."""
    listed = F.array_sort(F.collect_list(F.struct("date", "n")))
    return counts.groupBy("token").agg(F.map_from_entries(listed).alias("counts"), F.sum("n").alias("total"))


def document_frequency(rows: DataFrame) -> DataFrame:
    """rows(tokens, is_dup) to (token, frequency, frequency_deduped), in one pass over the corpus."""
    each = rows.select("is_dup", F.explode(F.array_distinct("tokens")).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("frequency"), F.count_if(~F.col("is_dup")).alias("frequency_deduped"))


def rows_per_day(rows: DataFrame) -> DataFrame:
    return rows.where((F.size("tokens") > 0) & (F.coalesce(F.col("date"), F.lit("")) != "")).groupBy("date").agg(F.count("*").alias("n_rows"))


def unique_per_source(rows: DataFrame, approximate: bool = False) -> DataFrame:
    """(source, unique_tokens, unique_authors)."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    tokens = rows.select("source", F.explode(F.array_distinct("tokens")).alias("token"))
    if not approximate:
        tokens = tokens.distinct()
    per = tokens.groupBy("source").agg((F.count("token") if not approximate else distinct("token")).alias("unique_tokens"))
    authors = rows.groupBy("source").agg(F.countDistinct("author").alias("unique_authors"))
    return authors.join(per, "source", "left").select("source", F.coalesce("unique_tokens", F.lit(0).cast("long")).alias("unique_tokens"), "unique_authors")


def corpus_totals(rows: DataFrame, frequencies: DataFrame, dictionary_min: int = 2000) -> DataFrame:
    of_rows = rows.agg(F.count("*").alias("n_rows"), F.count_if("is_dup").alias("dup_rows"), F.countDistinct("date").alias("n_dates"), F.countDistinct("source").alias("n_sources"))
    deduped = F.col("frequency_deduped")
    of_tokens = frequencies.agg(F.count("*").alias("unique_tokens"), F.count_if(deduped > 0).alias("unique_tokens_deduped"), F.count_if((deduped >= dictionary_min) & F.col("token").rlike(r"^\p{L}+$")).alias("dictionary_terms"))
    return of_rows.crossJoin(F.broadcast(of_tokens)).withColumn("deduped_rows", F.col("n_rows") - F.col("dup_rows"))  # one row each


def frequency_distribution(frequencies: DataFrame) -> DataFrame:
    """(terms, most, least, upper_median): the median is the element in place n // 2 of the descending order, found from the histogram."""
    from pyspark.sql import Window as W

    histogram = frequencies.groupBy("count").agg(F.count("*").alias("k"))
    down = W.orderBy(F.desc("count")).rowsBetween(W.unboundedPreceding, 0)  # a row for each distinct count, not for each term
    placed = histogram.withColumn("upto", F.sum("k").over(down)).withColumn("n", F.sum("k").over(W.partitionBy()))
    middle = F.max(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("count")))
    return placed.agg(F.sum("k").alias("terms"), F.max("count").alias("most"), F.min("count").alias("least"), middle.alias("upper_median"))


def dictionary(frequencies: DataFrame, least: int = 2000) -> DataFrame:
    """(term, count) of alphabetic tokens whose deduplicated frequency reaches ``least``."""
    return frequencies.where((F.col("frequency_deduped") >= least) & F.col("token").rlike(r"^\p{L}+$")).select(F.col("token").alias("term"), F.col("frequency_deduped").alias("count"))
