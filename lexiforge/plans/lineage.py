"""Cutting a plan's lineage into the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own if that is unset, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='lexiforge-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in spark.checkpoint.dir, or in a folder of our own if that is unset: computed once, and safe from lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
