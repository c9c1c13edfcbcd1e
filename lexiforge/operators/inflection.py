"""Inflected forms folded into their base by suffix rules, as an equi self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BASE = 3
# Suffix, least length of the token, letters dropped, letters added, name; in order of precedence.
RULES = (("ies", 7, 3, "y", "ies->y"), ("es", 6, 2, "", "es->base"), ("es", 6, 1, "", "es->base+e"), ("ing", 7, 3, "", "ing->base"), ("ing", 7, 3, "e", "ing->base+e"), ("s", 5, 1, "", "s->base"))


def candidate_bases(token: Column) -> Column:
    """array<struct<k, base, rule>> of the rules that apply; every base is shorter than the token."""
    out = []
    for k, (suffix, least, drop, add, name) in enumerate(RULES):
        hit = token.endswith(F.lit(suffix)) & (F.length(token) >= least)
        if suffix == "s":
            hit &= ~token.endswith(F.lit("ss")) & ~token.endswith(F.lit("us"))
        base = F.concat(F.substring(token, F.lit(1), F.length(token) - drop), F.lit(add))
        out.append(F.when(hit, F.struct(F.lit(k).alias("k"), base.alias("base"), F.lit(name).alias("rule"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull() & (F.length(x["base"]) >= MIN_BASE))


def inflections(tokens: DataFrame) -> DataFrame:
    """(token, base, rule) of tokens that the first rule with a base among the tokens folds.

    Rules shorten a token, so whether a base is folded itself never matters, and no iteration is needed.
    """
    each = tokens.select("token", F.explode(candidate_bases(F.col("token"))).alias("c")).select("token", F.col("c.k").alias("k"), F.col("c.base").alias("base"), F.col("c.rule").alias("rule"))
    found = each.join(tokens.select(F.col("token").alias("base")), "base")
    return found.groupBy("token").agg(F.min(F.struct("k", "base", "rule")).alias("x")).select("token", "x.base", "x.rule")


def fold(labelled: DataFrame) -> DataFrame:
    """labelled(token, final_label) with dedup_status, base and rule; only NEOLOGISM rows are folded."""
    new = labelled.where("final_label = 'NEOLOGISM'").select("token").distinct()
    joined = labelled.join(inflections(new), "token", "left")
    status = F.when(F.col("final_label") != "NEOLOGISM", "not_neologism").when(F.col("base").isNotNull(), "dropped").otherwise("kept")
    return joined.select("token", "final_label", status.alias("dedup_status"), F.coalesce("base", F.lit("")).alias("base"), F.coalesce("rule", F.lit("")).alias("rule"))


def rule_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("n_tokens"))


def reduction(full: DataFrame) -> DataFrame:
    """(neologisms, dropped, kept, pct): by how much folding shortens the list of new words."""
    new, gone = F.count_if(F.col("dedup_status") != "not_neologism"), F.count_if(F.col("dedup_status") == "dropped")
    pct = F.when(new > 0, F.round(gone.cast("double") / new * F.lit(100.0).cast("double"), 2)).otherwise(F.lit(0.0).cast("double"))
    return full.agg(new.alias("neologisms"), gone.alias("dropped"), (new - gone).alias("kept"), pct.alias("pct"))
