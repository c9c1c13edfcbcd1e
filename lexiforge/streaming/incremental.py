"""Incremental document frequencies: each file is counted once, over any number of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators.counts import term_day_counts


def ingest(spark: SparkSession, source: str, schema, tokens, out: str, checkpoint: str, file_format: str = "parquet") -> None:
    """Count what is new in ``source`` and stop. A batch replaces its own partition, so a replay after a crash changes nothing.

    tokens: rows to rows(date, tokens).
    """

    def write(batch: DataFrame, number: int) -> None:
        term_day_counts(tokens(batch)).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    stream = spark.readStream.format(file_format).schema(schema).load(source)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """(token, date, n) over all batches so far."""
    return spark.read.parquet(out).groupBy("token", "date").agg(F.sum("n").alias("n"))


def daily_terms(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """stream(ts, tokens) to (window, token, n) with a watermark, in append mode."""
    each = stream.withWatermark("ts", late).select("ts", F.explode("tokens").alias("token"))
    return each.groupBy(F.window("ts", "1 day"), "token").agg(F.count("*").alias("n"))
