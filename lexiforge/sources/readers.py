"""Readers of the corpus, of logs and of reference lists."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.functions.text import day, parse_token_list, source_of_file

TEXT_COLUMNS = ("text", "body")
COLUMNS = ("id", "author", "date", "source")
_OVER = "__overflow"
_NO_VALUE = uuid.uuid4().hex  # what the parser takes an empty field without quotes for; one in quotes is an empty string


def corpus_files(spark: SparkSession, folder: str, pattern: str = "*.csv.gz") -> list[str]:
    """Sorted paths of the files in a folder, by any file system that Spark reads; none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in (found or []))


def header_of(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def csv_rows(spark: SparkSession, paths: str | list[str], columns: list[str], quoted: bool = True) -> DataFrame:
    """Rows of CSV files with this header: rows with too many fields are skipped, short rows are filled with nulls.

    An empty field is null, and an empty string in quotes. Without quotes, quote characters are data; malformed UTF-8
    becomes U+FFFD, and a corrupt file ends where it breaks.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _OVER]])
    options = {"header": True, "multiLine": quoted, "quote": '"' if quoted else "", "escape": '"' if quoted else "\\", "enforceSchema": True, "encoding": "UTF-8", "ignoreCorruptFiles": not quoted, "nullValue": _NO_VALUE}
    if quoted:
        options |= {"charToEscapeQuoteEscaping": '"'}  # unset, it is NUL, and the parser loses a NUL in quotes
    return spark.read.schema(schema).options(**options).csv(paths).where(F.col(_OVER).isNull()).drop(_OVER)


def broken_files(spark: SparkSession, paths: list[str]) -> set[str]:
    """Files that a parse with quotes can't be trusted with: an odd number of quotes, so one stays open, or bytes that aren't UTF-8."""
    lines = spark.read.option("ignoreCorruptFiles", True).text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    quotes = F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    found = lines.groupBy("path").agg((quotes % 2 == 1).alias("open"), F.max(F.contains("value", F.lit("\ufffd"))).alias("bytes"))
    return {r["path"] for r in found.where("open or bytes").collect()}


def read_corpus_safe(spark: SparkSession, paths: list[str], partitions: int | None = None) -> DataFrame:
    """As ``read_corpus``: files with quotes where these are sound, the others without, each file one way."""
    broken = broken_files(spark, paths) if paths else set()
    plain = lambda p: p.removeprefix("file:").lstrip("/")
    bad = {plain(p) for p in broken}
    parts = [read_corpus(spark, own, quoted) for quoted in (True, False) if (own := [p for p in paths if (plain(p) not in bad) == quoted])]
    out = reduce(DataFrame.unionByName, parts) if parts else read_corpus(spark, [])
    return out.repartition(partitions) if partitions else out


def read_corpus(spark: SparkSession, paths: list[str], quoted: bool = True, partitions: int | None = None) -> DataFrame:
    """(id, author, date, source, text, tokens) of CSV files with a text column; others are left out.

    Files with one header are read together; the text column is chosen for each header, text before body. Compressed
    CSV is one task a file: ``partitions`` deals the rows out again.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        by_header.setdefault(tuple(header_of(spark, path)), []).append(path)
    frames = []
    for header, own in by_header.items():
        text = next((c for c in TEXT_COLUMNS if c in header), None)
        if text is None:
            continue
        rows = csv_rows(spark, own, list(header), quoted).withColumn("_file", F.col("_metadata.file_name"))
        col = lambda c: F.col(c) if c in header else F.lit(None).cast("string")  # noqa: E731, B023
        source = F.col("subreddit") if "subreddit" in header else F.col("source") if "source" in header else source_of_file(F.col("_file"))
        tokens = parse_token_list(F.col("tokenized_text")) if "tokenized_text" in header else F.lit(None).cast("array<string>")
        frames.append(rows.select(col("id").alias("id"), col("author").alias("author"), day(col("date")).alias("date"), source.alias("source"), F.col(text).alias("text"), tokens.alias("tokens")))
    if not frames:
        return spark.createDataFrame([], "id string, author string, date string, source string, text string, tokens array<string>")
    out = reduce(DataFrame.unionByName, frames)
    return out.repartition(partitions) if partitions else out


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Lines that aren't JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(token): trimmed lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("token")).where("token <> ''")


def read_tsv(spark: SparkSession, path: str | list[str], columns: list[str], header: bool = False, least: int = 2) -> DataFrame:
    """Tab-separated text columns; lines that start with # and those with fewer than ``least`` fields are skipped."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"sep": "\t", "header": header, "comment": "#", "quote": "", "enforceSchema": True}
    return spark.read.schema(schema).options(**options).csv(path).where(F.col(columns[least - 1]).isNotNull())


def result_path(spark: SparkSession, folder: str, model: str, override: str | None = None) -> str | None:
    """An explicit path, else the model's log, else the last of its tables by name."""
    if override:
        return override
    log = corpus_files(spark, folder, f"results_{model}.jsonl")
    tables = corpus_files(spark, folder, f"classified_{model}_*.tsv")
    return log[0] if log else tables[-1] if tables else None


def token_counts(frequencies: DataFrame | None, term_counts: DataFrame | None) -> DataFrame:
    """(token, n): deduplicated document frequencies where there are any, else sums of term counts, which is another statistic."""
    if frequencies is not None:
        return frequencies.select("token", F.col("frequency_deduped").alias("n"))
    if term_counts is None:
        raise ValueError("neither frequencies nor term counts")
    return term_counts.groupBy("token").agg(F.sum("n").alias("n"))


# Templates and categories of pages that only list others, in lower case; as the page is lower-cased, one in capitals never matches.
DISAMBIGUATION = (
    "{{disambig", "{{disambiguation", "{{dab}}", "{{hndis", "{{geodis", "{{surname", "{{given name", "{{ship index", "{{set index",
    "{{letter-number", "{{mathdab", "{{numberdis", "{{letter disambig", "{{species latin name disambiguation",
    "{{taxonomic authorities disambiguation", "{{callsign disambig", "{{airport disambig", "{{school disambig", "{{hospital disambig",
    "{{mil-unit-dis", "category:disambiguation", "category:all disambiguation pages", "category:all set index articles",
)


def is_disambiguation(text):
    low = F.lower(text)
    out = F.lit(False)
    for mark in DISAMBIGUATION:
        out = out | F.contains(low, F.lit(mark))
    return F.coalesce(out, F.lit(False))


def encyclopaedia_titles(spark: SparkSession, path: str) -> DataFrame:
    """(token): lower-case titles of a wiki dump (XML, also compressed) that are no redirect, list of pages or page of another name space."""
    schema = "title string, redirect struct<_title:string>, revision struct<text:struct<_VALUE:string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    own = pages.where(F.col("redirect").isNull() & ~F.contains("title", F.lit(":")) & ~is_disambiguation(F.col("revision.text._VALUE")))
    return own.select(F.lower(F.trim("title")).alias("token")).distinct()


def dictionary_titles(spark: SparkSession, path: str, marker: str = "==English==") -> DataFrame:
    """(token): lower-case titles of a dictionary dump whose page has the language's section."""
    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<text:struct<_VALUE:string>>").load(path)
    own = pages.where(~F.contains("title", F.lit(":")) & F.contains("revision.text._VALUE", F.lit(marker)))
    return own.select(F.lower(F.trim("title")).alias("token")).distinct()


def word_lists(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(token): the words of all list files of a folder, lower-case, once each."""
    files = corpus_files(spark, folder, pattern)
    return read_lines(spark, files).select(F.lower("token").alias("token")).distinct() if files else spark.createDataFrame([], "token string")


def pending_terms(words: DataFrame, accepted: DataFrame) -> DataFrame:
    """Words that aren't accepted yet; those that were asked for and rejected are asked for again."""
    return words.join(accepted.select("token"), "token", "left_anti")


def read_replies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Replies of a dictionary service that were fetched before, a JSON object a line, for ``api_terms``."""
    return read_jsonl(spark, path, "term string, list array<struct<written_on:string>>")


def api_terms(responses: DataFrame, cutoff: str) -> DataFrame:
    """responses(term, list array<struct<written_on>>) to (token) with any definition written before the cutoff; dates that can't be read are ignored."""
    plain = lambda d: F.regexp_replace(F.regexp_replace(F.translate(d["written_on"], "TZ", " "), r"\.\d+", ""), r"\s+$", "")
    early = F.exists("list", lambda d: F.coalesce(F.try_to_timestamp(plain(d), F.lit("yyyy-MM-dd HH:mm:ss")) < F.lit(cutoff).cast("timestamp"), F.lit(False)))
    return responses.where(early).select(F.lower(F.trim("term")).alias("token")).distinct()
