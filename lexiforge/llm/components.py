"""Connected components by alternating large-star and small-star steps; links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import drop, save


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of ids to (id, component): the smallest id reachable. Ids without a link to another are left out.

    Null ends and links of an id to itself are ignored; repeated links count once. No links: an empty table.
    """
    spark = links.sparkSession
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    now, path = save(links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), "links")
    before = None
    while True:
        following, new_path = save(_small_star(_large_star(now)), "links")
        drop(spark, path)
        now, path, after = following, new_path, mark(following)
        if after == before or not after["n"]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = after
