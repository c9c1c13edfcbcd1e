"""The whole pipeline as one lazy plan: candidates, typos, contexts, labels, folded forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.rules import is_valid_candidate
from lexiforge.functions.text import STOP_WORDS
from lexiforge.operators import classify, context, counts, duplicates, fuzzy, inflection, vocabulary, votes
from lexiforge.plans.lineage import cut


@dataclass(frozen=True)
class Limits:
    min_df: int = 100
    dictionary_min: int = 2000
    typo_reference: int = 500
    typo_count: int = 100
    contexts: int = 10
    shown: int = 3
    clip: int = 100


def novel_tokens(rows: DataFrame, vocab: DataFrame, share: float = 0.02, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(token, df): valid candidates outside the vocabulary that at least ``share`` of the rows hold, exact duplicates discounted.

    Two shuffles beyond the one for duplicates: tokens are counted with map-side combination, and the cheap shape
    rules and the anti-join run on counted tokens, not on occurrences.
    """
    kept = duplicates.drop_duplicates(rows, duplicates.duplicate_ids(rows))
    df = kept.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    # Mentions the count, so that the optimizer leaves the rules above the aggregate: they cost more than counting.
    valid = df.where(F.when(F.col("df") > 0, is_valid_candidate(F.col("token"), stop_words)))
    least = rows.agg((F.count("*") * F.lit(share).cast("double")).alias("least"))
    wide = valid.crossJoin(F.broadcast(least)).where(F.col("df") >= F.col("least")).select("token", "df")  # one row
    return vocabulary.outside(wide, vocab)


def candidates(rows: DataFrame, vocab: DataFrame, general: DataFrame, limits: Limits = Limits(), mode: str = "osa") -> DataFrame:
    """(token, n, status, detail): every distinct token with what became of it: kept, vocab, pattern, low_freq, merged or typo."""
    marked = duplicates.mark_duplicates(rows, duplicates.duplicate_ids(rows))
    freq = cut(counts.document_frequency(marked))
    first = vocabulary.candidates(freq.select("token"), vocab, freq, limits.min_df)
    open_ = first.where("status IN ('kept', 'low_freq')").select("token")
    known = vocab.join(freq.select("token", F.col("frequency_deduped").alias("n")), "token")
    merged = fuzzy.split_in_two(open_, known)
    terms = vocabulary.add_dictionaries(general, counts.dictionary(freq, limits.dictionary_min))
    typo = fuzzy.typos(open_.join(merged.select("token"), "token", "left_anti"), terms, mode, limits.typo_count)
    log = vocabulary.excluded_log(typo, merged)
    joined = first.join(log.select("token", "reason", F.col("detail").alias("other")), "token", "left")
    back = F.col("n") >= limits.min_df
    # What is frequent enough to come back is tested once more, against the most frequent of its own kind.
    again = fuzzy.second_pass_typos(joined.where(F.col("reason").isNotNull() & back).select("token", "n"), mode, limits.typo_reference, min_count=limits.typo_count)
    checked = joined.join(again.select("token", F.col("correction").alias("second")), "token", "left")
    status = F.when(F.col("second").isNotNull(), "typo").when(F.col("reason").isNotNull() & ~back, F.col("reason")).otherwise(F.col("status"))
    return checked.select("token", "n", status.alias("status"), F.coalesce("second", "other", "detail").alias("detail"))


def label(rows: DataFrame, tokens: DataFrame, models: dict[str, classify.Classifier], limits: Limits = Limits()) -> DataFrame:
    """(token, label, vote_type, agreement, a column for each model) of tokens, from their contexts."""
    placed = context.attach_texts(context.quota_pool(context.contexts_of(rows, tokens), limits.contexts), rows, limits.clip)
    index = cut(context.attach_contexts(tokens.select("token"), context.context_index(context.diverse(placed, limits.shown))))
    labels = None
    for name, model in models.items():
        own = cut(classify.classify(index, model, keep=cut)).withColumn("model", F.lit(name))
        labels = own if labels is None else labels.unionByName(own)
    return votes.majority(labels, list(models))


def folded(votes_: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """The labelled list with inflected forms of new words folded into their bases."""
    final = votes_.select("token", F.col("label").alias("final_label")) if verdicts is None else votes.apply_verdicts(votes_, verdicts)
    return inflection.fold(final)
