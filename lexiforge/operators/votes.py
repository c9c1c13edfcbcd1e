"""Labels of several models: last record wins, majority vote, agreement, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.functions.labels import LABELS, line_label, line_token, prompt, single_label, vote


def last_labels(log: DataFrame) -> DataFrame:
    """log(model, token, label, seq), append-only, to the last valid label of each (model, token)."""
    valid = log.where(F.upper("label").isin(*LABELS))
    return valid.groupBy("model", "token").agg(F.max_by(F.upper("label"), "seq").alias("label"))


def majority(labels: DataFrame, models: list[str]) -> DataFrame:
    """labels(model, token, label) to (token, label, vote_type, agreement, one column for each model); a missing vote is empty."""
    wide = labels.groupBy("token").pivot("model", models).agg(F.max("label"))
    cast = F.filter(F.array(*[F.col(m) for m in models]), lambda x: x.isNotNull())
    label, kind = vote(F.col("votes"))
    out = wide.withColumn("votes", cast).withColumns({"label": label, "vote_type": kind})
    agree = F.when(F.col("vote_type").isin("tie", "tie_2of2", "no_votes"), 0).otherwise(F.size(F.filter("votes", lambda x: x == F.col("label"))))
    return out.select("token", "label", "vote_type", agree.alias("agreement"), *[F.coalesce(m, F.lit("")).alias(m) for m in models])


def distribution(votes: DataFrame) -> DataFrame:
    return votes.groupBy("label", "vote_type").agg(F.count("*").alias("n_tokens"))


def coverage(votes: DataFrame, models: list[str]) -> DataFrame:
    """(models, n_tokens): how many tokens have a label of how many models."""
    voted = sum((F.when(F.col(m) != "", 1).otherwise(0) for m in models), F.lit(0))
    return votes.groupBy(voted.cast("int").alias("models")).agg(F.count("*").alias("n_tokens"))


def pairwise_agreement(labels: DataFrame) -> DataFrame:
    """(m1, m2, shared, agree, disagree, pct) for each pair of models, from a self-join on the token."""
    other = labels.select("token", F.col("model").alias("m2"), F.col("label").alias("l2"))
    joined = labels.select("token", F.col("model").alias("m1"), F.col("label").alias("l1")).join(other, "token").where("m1 < m2")
    same = F.count_if(F.col("l1") == F.col("l2"))
    pct = F.round(same.cast("double") / F.count("*") * F.lit(100.0).cast("double"), 2)
    return joined.groupBy("m1", "m2").agg(F.count("*").alias("shared"), same.alias("agree"), (F.count("*") - same).alias("disagree"), pct.alias("pct"))


def model_labels(labels: DataFrame) -> DataFrame:
    return labels.groupBy("model", "label").agg(F.count("*").alias("n_tokens"))


def parse_responses(responses: DataFrame, expected: DataFrame) -> DataFrame:
    """(group, response) and expected (group, token) to (group, token, label).

    A line is token:label; the last line of a token wins. Tokens without a line are UNKNOWN, or parsed from the
    whole response where they are the only one of their group.
    """
    lines = responses.select("group", F.posexplode(F.split("response", "\n")).alias("n", "line")).where(F.contains("line", F.lit(":")))
    lines = lines.select("group", "n", line_token(F.trim("line")).alias("token"), line_label(F.trim("line")).alias("label"))
    found = lines.groupBy("group", "token").agg(F.max_by("label", "n").alias("label"))
    alone = expected.groupBy("group").agg(F.count("*").alias("k"))
    joined = expected.join(found, ["group", "token"], "left").join(alone, "group").join(responses, "group", "left")
    label = F.coalesce("label", F.when(F.col("k") == 1, single_label(F.col("response"))).otherwise("UNKNOWN"))
    return joined.select("group", "token", label.alias("label"))


def to_verify(votes: DataFrame, judged: DataFrame) -> DataFrame:
    return votes.where("label = 'NEOLOGISM'").join(judged.select("token"), "token", "left_anti")


def apply_verdicts(votes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(token, final_label) of the NEOLOGISM rows that have been judged; an UNKNOWN verdict is NONE."""
    final = F.when(F.col("verdict").isin(*LABELS), F.col("verdict")).otherwise("NONE")
    return votes.where("label = 'NEOLOGISM'").join(verdicts.select("token", "verdict"), "token").select("token", final.alias("final_label"))


def overruled(final: DataFrame) -> DataFrame:
    """(judged, overruled, pct)."""
    other = F.count_if(F.col("final_label") != "NEOLOGISM")
    pct = F.when(F.count("*") > 0, F.round(other.cast("double") / F.count("*") * F.lit(100.0).cast("double"), 2)).otherwise(F.lit(0.0).cast("double"))
    return final.agg(F.count("*").alias("judged"), other.alias("overruled"), pct.alias("pct"))


def verdict_breakdown(final: DataFrame) -> DataFrame:
    """(final_label, n_tokens, pct) of the judged rows."""
    total = F.sum(F.sum("one")).over(W.partitionBy())
    counted = final.withColumn("one", F.lit(1)).groupBy("final_label").agg(F.sum("one").alias("n_tokens"), total.alias("total"))  # four labels
    return counted.select("final_label", "n_tokens", F.round(F.col("n_tokens").cast("double") / F.col("total") * F.lit(100.0).cast("double"), 2).alias("pct"))


def usage(responses: DataFrame) -> DataFrame:
    """Sums of responses(model, input_tokens, output_tokens, cache_read, cache_written); what a reply doesn't tell is 0."""
    return responses.groupBy("model").agg(F.count("*").alias("replies"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_written")])


def parse_verdicts(responses: DataFrame) -> DataFrame:
    """responses(token, response) to (token, verdict): line by line the label after the colon, or one that stands there among other words; then any in the whole text; UNKNOWN is NONE."""
    label = single_label(F.col("response"), contained_in_line=True)
    return responses.select("token", F.when(label.isin(*LABELS), label).otherwise("NONE").alias("verdict"))


def verify(votes: DataFrame, judged: DataFrame, index: DataFrame, verifier, keep=lambda df: df) -> DataFrame:
    """Verdicts (token, verdict) of a verifier, a protocol like a classifier's, on NEOLOGISM rows that aren't judged yet; index(token, contexts)."""
    from lexiforge.operators.classify import respond

    asked = to_verify(votes, judged).select("token").join(index, "token").select("token", prompt(F.col("token"), F.col("contexts")).alias("prompt"))
    return parse_verdicts(keep(respond(asked, verifier)).select("token", "response"))
