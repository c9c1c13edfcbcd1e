"""License scans by diagonal voting, in DataFrame operations only.

The hashes of all rolling runs of K words are joined to their places in license templates. A hit votes for its
offset diagonal, place in the text minus place in the template; neighbouring diagonals, which an inserted or
missing word sets apart, are merged, and a cluster is verified by the share of the template's words that its
hits cover and by its length. Phrases that name a license are found beside, wherever their words stand in a row.

Null or empty text: no words, no label, score 0. Rows with equal doc_id and text get equal results, as often as
they occur. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so further columns
cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.llm.common import table

K = 4
NEAR_DIAGONALS = 3
MIN_COVERAGE = 0.7
MAX_STRETCH = 2.0

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public notices of the licenses; {w} words that licensees fill in are left out.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
        to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
        IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.""",
}

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(text: Column) -> Column:
    """The words, A-Z in lower case, with one space between two."""
    return F.btrim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _BETWEEN, " "))


def _grams(words: Column, k: int) -> Column:
    """Hash of the k words from each place on; places in order. Shorter texts: none."""
    at = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(k)]))


def template_places(spark: SparkSession, templates: dict[str, str], k: int = K) -> DataFrame:
    """template, length (words), place, gram."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, text string")
    words = rows.select("template", F.split(plain(F.col("text")), " ").alias("w"))
    return words.select("template", F.size("w").alias("length"), F.posexplode(_grams(F.col("w"), k)).alias("place", "gram"))


def spans(docs: DataFrame, templates: dict[str, str], k: int = K, near: int = NEAR_DIAGONALS, coverage: float = MIN_COVERAGE, stretch: float = MAX_STRETCH) -> DataFrame:
    """did, th (hash of the text), template, first, last (words of the span), coverage: verified spans of the templates."""
    places = template_places(docs.sparkSession, templates, k)  # as many rows as the templates have words
    words = docs.select(F.col("doc_id").cast("long").alias("did"), F.xxhash64("text").alias("th"), F.split(plain(F.col("text")), " ").alias("w"))
    grams = words.select("did", "th", F.posexplode(_grams(F.col("w"), k)).alias("at", "gram"))
    hits = grams.join(F.broadcast(places), "gram").select("did", "th", "template", "length", "place", "at", (F.col("at") - F.col("place")).alias("diagonal"))
    votes = hits.groupBy("did", "th", "template", "length", "diagonal").agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    order = W.partitionBy("did", "th", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > near, F.lit(True)).cast("int")
    merged = votes.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(order))
    whole = merged.groupBy("did", "th", "template", "length", "cluster").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + k - 1))))) / F.col("length")
    found = whole.select("did", "th", "template", "first", "last", "length", covered.alias("coverage"))
    return found.where((F.col("coverage") >= coverage) & (F.col("last") - F.col("first") + 1 <= stretch * F.col("length"))).drop("length")


def named(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """doc_id, th, n_words, n_base, first_word, last_word, base (sorted labels): places of the phrases."""
    any_of = "(?<![^ ])(?:" + "|".join(sorted(phrases)) + ")(?![^ ])"
    text = docs.select("doc_id", F.xxhash64("text").alias("th"), plain(F.col("text")).alias("s"))
    words = lambda c: F.length(c) - F.length(F.translate(c, " ", ""))  # noqa: E731  spaces, so words before
    n_words = F.when(F.col("s") == "", 0).otherwise(words(F.col("s")) + 1).cast("long")
    count = F.regexp_count("s", F.lit(any_of)).cast("long")
    before = lambda many: words(F.regexp_extract("s", f"(?s)^(.*{many}){any_of}", 1)).cast("long")
    base = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.col("s").rlike(f"(?<![^ ]){p}(?![^ ])"), F.lit(v)) for p, v in phrases.items()]), lambda x: x.isNotNull())))
    counted = text.select("doc_id", "th", n_words.alias("n_words"), count.alias("n_base"), "s")
    some = F.col("n_base") > 0
    return counted.select("doc_id", "th", "n_words", "n_base", F.when(some, before("?")).alias("first_word"), F.when(some, before("")).alias("last_word"), F.when(some, base).otherwise(F.array().cast("array<string>")).alias("base"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the verified spans, a row per row of docs.

    score: the best coverage of a template, at least 0.5 where a phrase stands.
    """
    base = named(docs, phrases or PHRASES)
    found = spans(docs, templates or TEMPLATES).groupBy("did", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last", "template", "coverage"))).alias("spans"), F.max("coverage").alias("best"), F.collect_set("template").alias("own"))
    joined = base.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("did")) & (base["th"] == found["th"]), "left")
    own = F.coalesce("own", F.array().cast("array<string>"))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"), score.cast("double").alias("score"), "spans")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def _sql(templates: dict[str, str], phrases: dict[str, str], k: int = K) -> str:
    """The scan in DuckDB's SQL: words are compared, not hashes."""
    quoted = lambda x: "'" + " ".join(x.split()).replace("'", "''") + "'"
    rows = lambda pairs: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in sorted(pairs.items()))
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = f"unnest(range(1, len(w) - {k - 2})) AS pos"
    gram = f"array_to_string(w[pos:pos + {k - 1}], ' ')"
    return f"""
WITH words AS (
  SELECT doc_id, {words} AS w FROM documents
), phrases AS (
  SELECT string_split(col0, ' ') AS p, col1 AS label FROM (VALUES {rows(phrases)})
), places AS (
  SELECT doc_id, pos - 1 AS pos, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM words) x JOIN phrases ON w[pos] = p[1] AND w[pos:pos + len(p) - 1] = p
), base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id
), templates AS (
  SELECT col0 AS template, {words.replace("text", "col1")} AS w FROM (VALUES {rows(templates)})
), of_template AS (
  SELECT template, len(w) AS length, pos AS place, {gram} AS gram FROM (SELECT *, {grams} FROM templates)
), hits AS (
  SELECT doc_id, template, length, place, pos, pos - place AS diagonal FROM (SELECT doc_id, pos, {gram} AS gram FROM (SELECT *, {grams} FROM words)) JOIN of_template USING (gram)
), fresh AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {NEAR_DIAGONALS} THEN 0 ELSE 1 END AS fresh FROM hits
), clusters AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS cluster FROM fresh
), covered AS (
  SELECT DISTINCT doc_id, template, cluster, unnest(range(place, place + {k})) AS word FROM clusters
), cover AS (
  SELECT doc_id, template, cluster, count(*) AS n FROM covered GROUP BY doc_id, template, cluster
), extent AS (
  SELECT doc_id, template, cluster, any_value(length) AS length, max(pos) + {k - 1} - min(pos) + 1 AS stretch FROM clusters GROUP BY doc_id, template, cluster
), spans AS (
  SELECT doc_id, template, n / length AS coverage FROM cover JOIN extent USING (doc_id, template, cluster) WHERE n / length >= {MIN_COVERAGE} AND stretch <= {MAX_STRETCH} * length
), best AS (
  SELECT doc_id, max(coverage) AS best, list(DISTINCT template) AS own FROM spans GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(labels, []) || coalesce(own, []))), ',') AS labels, CAST(greatest(coalesce(best, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)
"""


OP10_SQL = _sql(TEMPLATES, PHRASES)
