"""Contexts of candidates: semi-join on tokens, quota by source, three diverse ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.functions.text import clip_balanced, clip_window

MAX_CONTEXTS, MIN_TOKENS = 10, 15


def contexts_of(rows: DataFrame, tokens: DataFrame, per_source_cap: int | None = None) -> DataFrame:
    """rows(id, source, tokens) to (token, id, source, tc): a row for each candidate in each row; tc: its number of tokens.

    Texts aren't carried along: they are attached to the few contexts that are kept.
    """
    each = rows.select("id", "source", F.size("tokens").cast("long").alias("tc"), F.explode(F.array_distinct("tokens")).alias("token"))
    found = each.join(tokens.select("token"), "token", "left_semi").select("token", "id", "source", "tc")
    if per_source_cap is None:
        return found
    order = W.partitionBy("token", "source").orderBy("id")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_source_cap).drop("k")


def attach_texts(contexts: DataFrame, rows: DataFrame, limit: int | None = 100) -> DataFrame:
    """contexts with the clipped text of their row; those whose clip misses the token are left out."""
    joined = contexts.join(rows.select("id", "source", "text"), ["id", "source"])
    if limit is not None:
        joined = joined.withColumn("text", clip_window(F.col("text"), F.col("token"), limit))
    return joined.where(F.contains(F.lower("text"), F.lower("token"))).select(*contexts.columns, "text")


def attach_facts(contexts: DataFrame, rows: DataFrame) -> DataFrame:
    """contexts with length and md5 of their row's whole text, for ``diverse`` without clipping: no copy of a text for each context."""
    facts = rows.where("text is not null").select("id", "source", F.length("text").alias("text_length"), F.md5("text").alias("text_md5"))
    return contexts.join(facts, ["id", "source"]).select(*contexts.columns, "text_length", "text_md5")


def quota_pool(pool: DataFrame, most: int = MAX_CONTEXTS, least_tokens: int = MIN_TOKENS) -> DataFrame:
    """(token, id, source, tc, place): the contexts kept of each token, at most ``most``.

    One source: its longest. Else the three largest sources share the places evenly, earlier ones get what is left
    over, and only further sources fill up. Texts under ``least_tokens`` count only where a token has no longer one.
    Of each source only its first ``most`` rows go on to the windows over a token, so a frequent token is no hot task.
    """
    token, source = W.partitionBy("token"), W.partitionBy("token", "source")
    down = source.orderBy(F.desc("tc"), "id")
    # One pass over the pool, dealt by the token; the longest of a source are its longest too where short ones don't count.
    top = pool.withColumns({"rs": F.row_number().over(down), "f": F.first(F.struct((-F.col("tc")).alias("t"), "id")).over(down)})
    top = top.withColumns({"all": F.count("*").over(source), "rich": F.count_if(F.col("tc") >= least_tokens).over(source)}).where(F.col("rs") <= most)
    top = top.withColumn("any", F.max("rich").over(token) > 0).where(~F.col("any") | (F.col("tc") >= least_tokens))
    top = top.withColumn("n", F.when(F.col("any"), F.col("rich")).otherwise(F.col("all")))
    top = top.withColumn("sr", F.dense_rank().over(token.orderBy(F.desc("n"), "f", "source")))
    top = top.withColumn("m", F.least(F.lit(3), F.max("sr").over(token)))
    slots = F.when(F.col("m") == 1, most).when(F.col("sr") > 3, 0).otherwise(F.floor(F.lit(most) / F.col("m")) + F.when(F.col("sr") <= F.pmod(F.lit(most), F.col("m")), 1).otherwise(0))
    kind = F.when(F.col("rs") <= slots, 0).when(F.col("sr") > 3, 1)
    placed = top.withColumn("kind", kind).where("kind is not null")
    placed = placed.withColumn("place", F.row_number().over(token.orderBy("kind", "sr", "rs")))
    return placed.where(F.col("place") <= most).select("token", "id", "source", "tc", "place")


def diverse(pool: DataFrame, most: int = 3, qualify: int = 10, limit: int | None = 110) -> DataFrame:
    """(token, id, source, text, place): three contexts from up to three sources, the longest texts first.

    pool(token, id, source, text, place). The largest source always qualifies, the next two if they have ``qualify``
    contexts; further contexts fill up with texts that differ after clipping. Without a limit, the pool may come from
    ``attach_facts`` and has no texts then, nor has the result.
    """
    token, source = W.partitionBy("token"), W.partitionBy("token", "source")
    texts = "text" in pool.columns
    if not texts and limit is not None:
        raise ValueError("no texts to clip")
    own = pool.withColumns({"text_length": F.length("text"), "text_md5": F.md5("text")}) if texts else pool
    first = F.row_number().over(W.partitionBy("token", F.when(F.col("text_length") > 0, F.col("text_md5")).otherwise(F.col("id").cast("string"))).orderBy("place"))
    own = own.withColumn("k", first).where("k = 1").withColumn("n", F.count("*").over(source)).withColumn("f", F.min("place").over(source))
    own = own.withColumn("sr", F.dense_rank().over(token.orderBy(F.desc("n"), "f")))
    own = own.withColumn("qual", (F.col("sr") == 1) | ((F.col("sr") <= 3) & (F.col("n") >= qualify)))
    own = own.withColumn("nq", F.max(F.when(F.col("qual"), F.col("sr"))).over(token))
    longest = F.when(F.col("qual"), -F.col("text_length")).otherwise(0)
    own = own.withColumn("rs", F.row_number().over(source.orderBy(longest, "place")))
    slots = F.when(F.col("nq") == 1, most).when(F.col("nq") == 2, F.when(F.col("sr") == 1, 2).otherwise(1)).otherwise(1)
    own = own.where(~F.col("qual") | (F.col("rs") <= slots))
    if limit is not None:
        own = own.withColumn("text", clip_balanced(F.col("text"), F.col("token"), limit)).withColumn("text_md5", F.md5("text"))
    order = [F.desc("qual"), F.col("sr"), F.col("rs")]
    again = F.row_number().over(W.partitionBy("token", "text_md5").orderBy(*order))
    own = own.withColumn("again", again).where(F.col("qual") | (F.col("again") == 1))
    return own.withColumn("rank", F.row_number().over(token.orderBy(*order))).where(F.col("rank") <= most).select("token", "id", "source", *(["text"] if texts else []), F.col("rank").alias("place"))


def context_index(contexts: DataFrame) -> DataFrame:
    """(token, contexts array<struct<text, source, id>>) in order of place."""
    listed = F.array_sort(F.collect_list(F.struct("place", "text", "source", "id")))
    return contexts.groupBy("token").agg(F.transform(listed, lambda c: F.struct(c["text"].alias("text"), c["source"].alias("source"), c["id"].alias("id"))).alias("contexts"))


def attach_contexts(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """Every token with its contexts, an empty list where it has none."""
    return tokens.join(index, "token", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast(index.schema["contexts"].dataType)))


def context_totals(tokens: DataFrame, contexts: DataFrame) -> DataFrame:
    per = contexts.groupBy("token").agg(F.count("*").alias("n"))
    joined = tokens.select("token").join(per, "token", "left")
    total = F.coalesce(F.sum("n"), F.lit(0).cast("long"))
    return joined.agg(F.count("n").alias("with_contexts"), F.count_if(F.col("n").isNull()).alias("without"), total.alias("contexts"))
