"""Reference vocabularies, the candidate funnel, frequency thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.rules import reject_reason
from lexiforge.functions.text import STOP_WORDS


def union_vocabulary(*lists: DataFrame) -> DataFrame:
    """Distinct trimmed lower-case entries of one-column tables, as (token)."""
    own = [x.select(F.lower(F.trim(F.col(x.columns[0]))).alias("token")) for x in lists]
    return reduce(DataFrame.unionByName, own).where("token <> ''").distinct()


def before_cutoff(rows: DataFrame, cutoff: str) -> DataFrame:
    """Distinct tokens of rows(date, tokens) dated before ``cutoff``, by string comparison."""
    return union_vocabulary(rows.where(F.col("date") < cutoff).select(F.explode("tokens").alias("token")))


def frequencies_before_year(counts: DataFrame, year: int = 2015) -> DataFrame:
    """(token, date, n) to (term, count) over dates before the year; dates without a year are left out."""
    own = F.expr("try_cast(substring(date, 1, 4) AS int)") < year
    return counts.groupBy(F.col("token").alias("term")).agg(F.sum(F.when(own, F.col("n")).otherwise(0)).alias("count")).where("count > 0")


def outside(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return tokens.join(vocabulary.select(F.col("token").alias("_v")), F.lower("token") == F.col("_v"), "left_anti")


def inside(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return tokens.join(vocabulary.select(F.col("token").alias("_v")), F.lower("token") == F.col("_v"), "left_semi")


def candidates(tokens: DataFrame, vocabulary: DataFrame, frequencies: DataFrame, least: int = 100, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(token, n, status, detail): status is vocab, pattern, low_freq, no_count or kept; one row per token, nothing is lost."""
    known = vocabulary.select(F.col("token").alias("_v"), F.lit(True).alias("in_vocab"))
    counted = frequencies.select("token", F.col("frequency_deduped").alias("n"))
    joined = tokens.join(known, F.lower("token") == F.col("_v"), "left").join(counted, "token", "left")
    reason = reject_reason(F.col("token"), stop_words)
    status = F.when(F.col("in_vocab"), "vocab").when(reason.isNotNull(), "pattern").when(F.col("n").isNull(), "no_count").when(F.col("n") < least, "low_freq").otherwise("kept")
    return joined.select("token", F.coalesce("n", F.lit(0).cast("long")).alias("n"), status.alias("status"), F.when(~F.coalesce("in_vocab", F.lit(False)), reason).alias("detail"))


def split_by_frequency(tokens: DataFrame, counts: DataFrame, least: int = 100) -> DataFrame:
    """(token, n, kept): counts(token, n) joined from the left; missing counts are 0."""
    joined = tokens.join(counts.select("token", "n"), "token", "left").select("token", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return joined.withColumn("kept", F.col("n") >= least)


def excluded_log(typos: DataFrame, merged: DataFrame) -> DataFrame:
    """(token, reason, detail) of both logs, each token once; a typo wins."""
    both = typos.select("token", F.lit("typo").alias("reason"), F.col("correction").alias("detail"), F.lit(0).alias("p")).unionByName(merged.select("token", F.lit("merged").alias("reason"), F.col("segmented").alias("detail"), F.lit(1).alias("p")))
    return both.groupBy("token").agg(F.min(F.struct("p", "reason", "detail")).alias("x")).select("token", "x.reason", "x.detail")


def reintegrate(excluded: DataFrame, counts: DataFrame, least: int = 100) -> DataFrame:
    """Excluded tokens that are frequent all the same: (token, n, reason, detail)."""
    return excluded.join(counts.select("token", "n"), "token").where(F.col("n") >= least).select("token", "n", "reason", "detail")


def merge_dictionaries(*sources: DataFrame) -> DataFrame:
    """(term, count) of the first source that has the term."""
    own = [s.select("term", "count", F.lit(i).alias("p")) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, own).groupBy("term").agg(F.min_by("count", F.struct("p", -F.col("count"))).alias("count"))


def add_dictionaries(*sources: DataFrame) -> DataFrame:
    """(term, count): counts of all sources added up."""
    return reduce(DataFrame.unionByName, [s.select("term", "count") for s in sources]).groupBy("term").agg(F.sum("count").alias("count"))


def funnel(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("status").agg(F.count("*").alias("n_tokens"))
