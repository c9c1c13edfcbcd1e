"""Model inference behind a classifier protocol: prompt groups, retry, resume."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.functions.labels import prompt, single_label
from lexiforge.operators.votes import parse_responses

GROUP = 10


class Classifier(Protocol):
    """Prompts to responses, in order; called on batches, so a model is loaded once in a worker."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def prompt_groups(tokens: DataFrame, size: int = GROUP, shards: int | None = None) -> DataFrame:
    """(token, group): at most ``size`` tokens a group, numbered inside hash shards (of about 20 000 tokens), so no task sees all tokens."""
    shards = shards or max(64, -(-tokens.count() // 20_000))
    shard = F.pmod(F.xxhash64("token"), F.lit(shards))
    order = W.partitionBy("shard").orderBy("token")
    numbered = tokens.select("token", shard.alias("shard")).withColumn("k", F.floor((F.row_number().over(order) - 1) / size))
    return numbered.select("token", F.concat_ws("-", F.col("shard").cast("string"), F.col("k").cast("string")).alias("group"))


def group_prompts(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, prompt) of index(token, contexts)."""
    each = groups.join(index, "token").select("group", "token", prompt(F.col("token"), F.col("contexts")).alias("p"))
    return each.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token", "p"))), lambda x: x["p"]), "\n\n").alias("prompt"))


def respond(prompts: DataFrame, classifier: Classifier, max_chars: int | None = None) -> DataFrame:
    """prompts(key, prompt) to (key, response); null where the prompt is longer than ``max_chars`` or the call fails."""
    key = next(c for c in prompts.columns if c != "prompt")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = [max_chars is None or len(p) <= max_chars for p in batch["prompt"]]
            try:
                got = iter(classifier([p for p, ok in zip(batch["prompt"], fits, strict=True) if ok]))
                out = [next(got) if ok else None for ok in fits]
            except Exception:  # a failed batch is retried token by token
                out = [None] * len(batch)
            yield pd.DataFrame({key: batch[key], "response": out})

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} string, response string")


def classify(index: DataFrame, classifier: Classifier, size: int = GROUP, max_chars: int | None = None, keep=lambda df: df) -> DataFrame:
    """index(token, contexts) to (token, label): in groups, then one by one where that gave none, then NONE.

    keep: materialises the responses, so no prompt is sent twice; the plans pass a checkpoint.
    """
    groups = prompt_groups(index, size)
    responses = keep(respond(group_prompts(index, groups), classifier, max_chars))
    first = parse_responses(responses.where("response is not null"), groups).select("token", "label")
    again = first.where("label = 'UNKNOWN'").join(index, "token").select("token", prompt(F.col("token"), F.col("contexts")).alias("prompt"))
    second = respond(again, classifier).select("token", single_label(F.col("response")).alias("retry"))
    label = F.when(F.col("label") != "UNKNOWN", F.col("label")).otherwise(F.when(F.col("retry") == "UNKNOWN", "NONE").otherwise(F.coalesce("retry", F.lit("NONE"))))
    return first.join(second, "token", "left").select("token", label.alias("label"))


def remaining(index: DataFrame, results: DataFrame) -> DataFrame:
    """Tokens that the result log has no valid label for yet."""
    done = results.where(~F.col("label").isin("UNKNOWN", "ERROR")).select("token")
    return index.join(done, "token", "left_anti")
