"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 1000
ROW_GROUP_BYTES = 32 << 20  # what a task that writes an intermediate table holds in memory


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hand texts to Python in batches of at most ``rows``, so a worker's memory follows single texts and not the default of 10 000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of a Python worker, that gives freed memory back to the system at its end: the worker stays for later stages."""

    @wraps(run)
    def outer(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return outer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % buckets


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or one of our own if it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='lexiforge-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write an intermediate table into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no remaining plan reads."""
    jvm: Any = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: sizes the number of partitions, never what is computed."""
    row = docs.agg(F.sum(F.octet_length(column).cast("long")).alias("n")).first()
    return int(row["n"] or 0)


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    """Partitions of about ``each`` bytes, at least the session's default parallelism."""
    return max(spark.sparkContext.defaultParallelism, -(-size // each))


def bounded(df: DataFrame, rows: int = 1_000_000, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it has no more than ``rows`` (narrow) rows; else as it is, for a shuffled join.

    weight: entries of an array that a row carries, which count instead of the row.
    """
    if weight is None:
        return F.broadcast(df) if df.count() <= rows else df
    n = df.agg(F.sum(F.greatest(weight, F.lit(1)).cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(df) if n <= rows else df


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, none of which df has in any spelling."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_by_key(rows: DataFrame, keyed: DataFrame, key: list[str], broadcast_rows: int = 1_000_000, hot_keys: int = 20_000) -> DataFrame:
    """Inner join of rows with keyed, a table of one row a key with ``n``, how many of rows have it; both are stored tables.

    A small keyed is broadcast. Else keys with over 1 / hot_keys of all rows, which are fewer than hot_keys, are
    broadcast and their rows stay where they are; the rest, of which no key is hot, meet by a shuffle.
    """
    size = keyed.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
    if size["keys"] <= broadcast_rows:
        return rows.join(F.broadcast(keyed), key)
    most = size["rows"] // hot_keys
    hot, rest = F.broadcast(keyed.where(F.col("n") > most)), keyed.where(F.col("n") <= most)
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest.hint("merge"), key)
    return rows.join(hot, key).unionByName(cold)
