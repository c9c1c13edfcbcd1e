"""Text expressions: normalisation, tokens, stop words, keyword-in-context clips. All are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of code points that count as emoji.
EMOJI_RANGES = ((0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF), (0x2702, 0x27B0), (0x24C2, 0x1F251))

STOP_WORDS = tuple(
    """a about above after again against all also am an and any are as at be because been before being below between both but by can cannot
    could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in
    into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she
    should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we
    were what when where which while who whom why will with would you your yours yourself yourselves""".split()
)

_MASKS = ((r"https?://\S+|www\.\S+", " URL "), (r"r/\w+", " SUBREDDIT "), (r"u/\w+", " USER "), (r"#\w+", " HASHTAG_TOKEN "))


def mask(text: Column, pattern: str, by: str) -> Column:
    """Unicode-aware replacement: word characters and white space are those of any script."""
    return F.regexp_replace(text, f"(?U){pattern}", by)


def normalise(text: Column) -> Column:
    """Links, source and user mentions and hashtags by place holders, emoji by a space, other non-ASCII dropped, white space squeezed; in this order."""
    for pattern, by in _MASKS:
        text = mask(text, pattern, by)
    emoji = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EMOJI_RANGES)
    text = F.regexp_replace(F.regexp_replace(text, f"[{emoji}]+", " "), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f]+", " "))


def tokens(text: Column, stop_words: tuple[str, ...] = (), pattern: str = "[a-z]+") -> Column:
    """Lower-case matches of ``pattern``; null text has none."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    if stop_words:
        found = F.filter(found, lambda t: ~t.isin(*stop_words))
    return F.coalesce(found, F.array().cast("array<string>"))


def parse_token_list(cell: Column) -> Column:
    """A list literal of strings in a cell; anything else is an empty list."""
    options = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    listed = F.when(F.ltrim(cell).startswith("["), F.from_json(cell, "array<string>", options))
    return F.coalesce(listed, F.array().cast("array<string>"))


def day(date: Column) -> Column:
    return F.substring(date.cast("string"), 1, 10)


def source_of_file(name: Column) -> Column:
    return F.regexp_replace(name, r"(_posts|_text_comments|_comments)\.csv\.gz$", "")


def clean_author(author: Column) -> Column:
    """New lines and tabs as spaces, for tab-separated tables."""
    return F.translate(author, "\n\r\t", "   ")


def shipped_stop_words(language: str = "english") -> tuple[str, ...]:
    """The list that Spark ships, which the dictionary builder and the vocabulary filter take instead of STOP_WORDS."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(language))


def md5_text(text: Column) -> Column:
    return F.md5(F.nullif(text, F.lit("")))


def words(text: Column) -> Column:
    squeezed = F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f]+", " "))
    return F.when(squeezed == "", F.array().cast("array<string>")).otherwise(F.split(squeezed, " "))


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once, not wherever the body mentions it (inside lambdas, once for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clip_window(text: Column, token: Column, limit: int = 100) -> Column:
    """Texts of more than ``limit`` words: ``limit`` words around the token's first place, which is told in characters of the squeezed text, with dots where words are cut."""

    def clip(own: Column) -> Column:
        def around(squeezed: Column) -> Column:
            before = F.substring(squeezed, F.lit(1), F.instr(F.lower(squeezed), F.lower(token)) - 1)
            at = F.length(before) - F.length(F.translate(before, " ", ""))
            return bind(F.greatest(F.lit(0), F.least(at - limit // 2, F.size(own) - limit)), cut)

        def cut(first: Column) -> Column:
            part = F.array_join(F.slice(own, first + 1, F.lit(limit)), " ")
            return F.concat(F.when(first > 0, "... ").otherwise(""), part, F.when(first + limit < F.size(own), " ...").otherwise(""))

        return F.when(F.size(own) <= limit, text).otherwise(bind(F.array_join(own, " "), around))

    return bind(words(text), clip)


def clip_balanced(text: Column, token: Column, limit: int = 110) -> Column:
    """Texts of more than ``limit`` words: around the occurrence with most words on its shorter side; at an edge the first or last ``limit`` words."""
    half = limit // 2 - 1

    def clip(own: Column) -> Column:
        n = F.size(own)
        part = lambda a, k: F.array_join(F.slice(own, a, F.lit(k)), " ")

        def cut(best: Column) -> Column:
            return F.when(best.isNull() | (best < half), part(F.lit(1), limit)).when(n - best - 1 < half, part(n - limit + 1, limit)).otherwise(part(best - half + 1, 2 * half + 1))

        places = F.transform(own, lambda w, i: F.when(F.contains(F.lower(w), F.lower(token)), F.struct(F.least(i, n - i - 1).alias("balance"), (-i).alias("minus"))))
        best = -F.array_max(F.filter(places, lambda x: x.isNotNull()))["minus"]
        return F.when(n <= limit, text).otherwise(bind(best, cut))

    return bind(words(text), clip)


def richness(text: Column, token: Column) -> Column:
    """Characters on the shorter side of the token's first place; -1 where it isn't."""
    at = F.instr(F.lower(text), F.lower(token))
    return F.when(at == 0, -1).otherwise(F.least(at - 1, F.length(text) - (at - 1) - F.length(token)))
