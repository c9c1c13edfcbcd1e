"""Language gates behind a pluggable detector."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages that count as foreign when detected.
RELEVANT_LANGUAGES = tuple(
    """portuguese german spanish french italian dutch turkish tagalog indonesian polish russian ukrainian czech slovak hungarian romanian
    swedish bokmal nynorsk danish finnish greek arabic hebrew hindi japanese korean chinese vietnamese thai malay catalan croatian serbian
    slovene bulgarian latvian lithuanian estonian albanian bosnian macedonian persian belarusian icelandic irish welsh basque gujarati marathi
    punjabi tamil telugu urdu""".split()
)
MIN_CONFIDENCE, MIN_CHARS = 0.75, 20


class LanguageDetector(Protocol):
    """Texts to (language or None, confidence); called on Arrow batches, so a model is loaded once in a worker."""

    def __call__(self, texts: pd.Series) -> pd.DataFrame: ...


def detect(text: Column, detector: LanguageDetector) -> Column:
    """struct<lang, conf>"""

    @F.pandas_udf("lang string, conf double")
    def run(x: pd.Series) -> pd.DataFrame:
        return detector(x)

    return run(text)


def is_foreign(lang: Column, conf: Column, least: float = MIN_CONFIDENCE) -> Column:
    """No language, English, one that isn't relevant, or too little confidence: not foreign."""
    known = lang.isNotNull() & (F.lower(lang) != "english") & F.lower(lang).isin(*RELEVANT_LANGUAGES)
    return F.coalesce(known & (conf >= least), F.lit(False))


def token_gate(tokens: DataFrame, detector: LanguageDetector, least: float = MIN_CONFIDENCE) -> DataFrame:
    """tokens with lang, conf and foreign."""
    seen = tokens.withColumn("d", detect(F.col("token"), detector))
    return seen.select(*tokens.columns, F.col("d.lang").alias("lang"), F.col("d.conf").alias("conf"), is_foreign(F.col("d.lang"), F.col("d.conf"), least).alias("foreign"))


def context_gate(index: DataFrame, detector: LanguageDetector, dictionary: DataFrame, least: float = MIN_CONFIDENCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """index(token, contexts) with lang, conf and status: kept, foreign, or reintegrated where the dictionary(term) has the token."""
    joined = F.array_join(F.transform("contexts", lambda c: c["text"]), " ")
    seen = index.withColumn("_t", joined).withColumn("d", detect(F.col("_t"), detector))
    foreign = (F.length("_t") >= min_chars) & is_foreign(F.col("d.lang"), F.col("d.conf"), least)
    known = seen.join(dictionary.select(F.col("term").alias("token"), F.lit(True).alias("_known")), "token", "left")
    status = F.when(~foreign, "kept").when(F.col("_known"), "reintegrated").otherwise("foreign")
    return known.select("token", "contexts", F.col("d.lang").alias("lang"), F.col("d.conf").alias("conf"), status.alias("status"))


def stop_word_detector(words: dict[str, tuple[str, ...]]) -> Callable[[pd.Series], pd.DataFrame]:
    """A detector for tests and small jobs: the language with the largest share of its stop words among the words."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            own = (text or "").lower().split()
            share = {k: sum(w in v for w in own) / len(own) for k, v in words.items()} if own else {}
            best = max(share, key=lambda k: (share[k], k), default=None)
            rows.append((best, share[best]) if best and share[best] else (None, 0.0))
        return pd.DataFrame(rows, columns=["lang", "conf"])

    return run
