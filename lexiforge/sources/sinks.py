"""Sinks: the tables, lists and reports of the stages. Sources are never changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators import counts, duplicates, inflection, votes
from lexiforge.plans.lineage import cut


def write_table(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_tsv(df: DataFrame, path: str, order=None, mode: str = "overwrite") -> None:
    """Tab-separated with a header, sorted over all files if an order is given."""
    own = df.orderBy(*order) if order else df
    own.write.mode(mode).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_lines(df: DataFrame, column: str, path: str, compress: bool = False, mode: str = "overwrite") -> None:
    """One value a line, sorted."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode(mode).option("compression", "gzip" if compress else "none").text(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_frequencies(frequencies: DataFrame, path: str) -> None:
    write_tsv(frequencies, path, order=[F.col("token")])


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    write_tsv(dictionary, path, order=[F.desc("count"), F.col("term")])


def write_token_counts(rollup: DataFrame, path: str) -> None:
    """{"token": ..., "counts": {date: n}} a line, sorted by token."""
    write_jsonl(rollup.select("token", "counts").orderBy("token"), path)


def exclusion_log(candidates: DataFrame, status: str) -> DataFrame:
    return candidates.where(F.col("status") == status).select("token", "n", "detail")


def report_sample(df: DataFrame, order: list, most: int = 200) -> DataFrame:
    """The first rows in order, for a report."""
    return df.orderBy(*order).limit(most)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report of a few rows as JSON, in one file."""
    report.coalesce(1).write.mode(mode).json(path)


def write_duplicates(rows: DataFrame, folder: str, least: int = duplicates.MIN_LENGTH) -> None:
    """The ids of later copies, the groups, and statistics of both."""
    write_tsv(duplicates.duplicate_ids(rows, least), f"{folder}/duplicate_ids", order=["source", "id"])
    write_jsonl(duplicates.duplicate_groups(rows, least), f"{folder}/duplicate_groups")
    write_report(duplicates.duplicate_stats(rows, least), f"{folder}/duplicate_stats")


def write_counts(rows: DataFrame, frequencies: DataFrame, folder: str) -> None:
    """Frequencies by token, rows by day, tokens by source, and totals; rows: with is_dup."""
    frequencies = cut(frequencies)
    write_frequencies(frequencies, f"{folder}/frequencies")
    write_tsv(counts.rows_per_day(rows), f"{folder}/rows_per_day", order=["date"])
    write_tsv(counts.unique_per_source(rows), f"{folder}/tokens_per_source", order=["source"])
    write_report(counts.corpus_totals(rows, frequencies), f"{folder}/totals")


def write_funnel(status: DataFrame, folder: str, foreign: DataFrame | None = None) -> DataFrame:
    """status(token, n, status, detail): candidates by token, the waiting list by falling count, what was caught as a typo or merged, and foreign(token, lang, conf).

    Each list sorts its rows, which reads them twice: status is computed once before, and given back as it is then.
    """
    status = cut(status)
    of = lambda kind: status.where(F.col("status") == kind).select("token", "n", "detail")
    write_tsv(of("kept").select("token", "n"), f"{folder}/candidates", order=["token"])
    write_tsv(of("low_freq").select("token", "n"), f"{folder}/waiting_list", order=[F.desc("n"), "token"])
    for kind in ("typo", "merged"):
        write_tsv(of(kind), f"{folder}/{kind}", order=["token"])
    if foreign is not None:
        write_tsv(foreign.select("token", "lang", "conf"), f"{folder}/foreign", order=[F.desc("conf"), "lang", "token"])
    write_report(status.groupBy("status").agg(F.count("*").alias("n_tokens")), f"{folder}/funnel")
    return status


def write_results(responses: DataFrame, labels: DataFrame, folder: str, mode: str = "append") -> None:
    """Raw responses, labels(model, token, label) in a folder a model, and how often each model gave each label."""
    write_jsonl(responses, f"{folder}/raw", mode)
    labels.write.mode(mode).partitionBy("model").option("sep", "\t").option("header", True).csv(f"{folder}/results")
    write_report(votes.model_labels(labels), f"{folder}/summary")


def write_votes(majority: DataFrame, models: list[str], folder: str, most: int = 200) -> None:
    """The votes by token; a report of their kinds, of coverage, and the first disagreements."""
    majority = cut(majority)
    write_tsv(majority, f"{folder}/votes", order=["token"])
    write_report(votes.distribution(majority), f"{folder}/vote_types")
    write_report(votes.coverage(majority, models), f"{folder}/coverage")
    write_report(report_sample(majority.where(F.col("vote_type").isin("majority", "tie", "tie_2of2")), ["token"], most), f"{folder}/disagreements")


def write_verdicts(final: DataFrame, folder: str) -> None:
    """The judged rows only, and how the verdicts are distributed."""
    final = cut(final)
    write_tsv(final, f"{folder}/verdicts", order=["token"])
    write_report(votes.verdict_breakdown(final), f"{folder}/breakdown")
    write_report(votes.overruled(final), f"{folder}/overruled")


def write_folded(full: DataFrame, folder: str, most: int = 300) -> None:
    """The list without folded forms, the full one, and a report with the first mappings."""
    full = cut(full)
    write_tsv(full.where("dedup_status <> 'dropped'").select("token", "final_label"), f"{folder}/deduplicated", order=["token"])
    write_tsv(full, f"{folder}/full", order=["token"])
    dropped = full.where("dedup_status = 'dropped'").select("token", "base", "rule")
    write_report(inflection.rule_counts(dropped), f"{folder}/rules")
    write_report(inflection.reduction(full), f"{folder}/reduction")
    write_report(report_sample(dropped, ["token"], most), f"{folder}/mappings")


def write_vocabulary(vocab: DataFrame, folder: str) -> None:
    """One word a line, sorted, and their number."""
    write_lines(vocab, "token", f"{folder}/vocabulary")
    write_report(vocab.agg(F.count("*").alias("n_tokens")), f"{folder}/vocabulary_stats")


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end, by the marker that the commit of the write leaves."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def stage(spark: SparkSession, path: str, make, force: bool = False) -> DataFrame:
    """The table that a stage has left at ``path``; made, as ``make()`` tells, if it isn't there whole or on force."""
    if force or not is_done(spark, path):
        write_table(make(), path)
    return spark.read.parquet(path)
