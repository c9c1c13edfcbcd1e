"""Labels of classifiers: parsing of responses, votes, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("ENTITY", "NEOLOGISM", "FOREIGN", "NONE")  # in the order of precedence where a text names several


def _contained(text: Column, default: str) -> Column:
    out = F.when(F.lit(False), "")
    for label in LABELS[: 3 if default == "NONE" else 4]:
        out = out.when(F.contains(text, F.lit(label)), label)
    return out.otherwise(default)


def line_token(line: Column) -> Column:
    """What stands before the last colon."""
    return F.trim(F.regexp_extract(line, r"^(.*):([^:]*)$", 1))


def line_label(line: Column) -> Column:
    """The label after the last colon, or the first one contained in it, else NONE."""
    label = F.upper(F.trim(F.regexp_extract(line, r"^(.*):([^:]*)$", 2)))
    return F.when(label.isin(*LABELS), label).otherwise(_contained(label, "NONE"))


def single_label(response: Column, contained_in_line: bool = False) -> Column:
    """First line with a valid label after its last colon; else the first label that the whole text contains; else UNKNOWN."""
    lines = F.transform(F.split(F.upper(F.trim(response)), "\n"), lambda x: F.trim(F.regexp_extract(F.trim(x), r":([^:]*)$", 1)))
    if contained_in_line:
        lines = F.transform(lines, lambda x: F.when(x.isin(*LABELS), x).otherwise(_contained(x, "")))
    valid = F.filter(lines, lambda x: x.isin(*LABELS))
    return F.when(response.isNull() | (response == ""), "UNKNOWN").otherwise(F.coalesce(F.get(valid, F.lit(0)), _contained(F.upper(response), "UNKNOWN")))


def vote(votes: Column) -> tuple[Column, Column]:
    """(label, vote type) of an array of up to three labels without nulls."""
    n = F.size(votes)
    a, b, c = (F.get(votes, F.lit(i)) for i in range(3))
    two = F.when((a == b) | (a == c), a).when(b == c, b)
    label = F.when(n == 3, F.coalesce(two, F.lit("NONE"))).when(n == 2, F.when(a == b, a).otherwise("NONE")).when(n == 1, a).otherwise("NONE")
    kind = F.when(n == 3, F.when((a == b) & (b == c), "unanimous").when(two.isNotNull(), "majority").otherwise("tie")).when(n == 2, F.when(a == b, "unanimous_2of2").otherwise("tie_2of2")).when(n == 1, "single").otherwise("no_votes")
    return label, kind


def prompt(token: Column, contexts: Column) -> Column:
    """A request to label one token; contexts: array<struct<text, source>>."""
    shown = F.transform(contexts, lambda c, i: F.concat(F.lit("  example "), (i + 1).cast("string"), F.lit(" from "), c["source"], F.lit(": "), c["text"]))
    listed = F.when(F.size(contexts) > 0, F.array_join(shown, "\n")).otherwise("  no example")
    return F.concat(F.lit(f"Label the word below as one of {', '.join(LABELS)}. If in doubt, say NONE.\nWORD: "), token, F.lit("\n"), listed, F.lit("\nReply with one line, word:LABEL."))
