"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Lines with a word are hashed. The gram of a line is the shortest run of lines from it on that has GRAM_WORDS
words; of the grams that begin within WINDOW_WORDS words, the one with the least hash is the window's fingerprint.
So any run of RUN_WORDS = GRAM_WORDS + WINDOW_WORDS - 1 words or more holds a whole window, and has that window's
fingerprint wherever it occurs. Fingerprints that stand at one place only are left out; the places of each other
one meet by its hash. From each of them the match is extended both ways, to the shortest runs of RUN_WORDS words
that go on from the window's start or end where it began; runs that hold the same lines meet by fingerprint and
hash of the run, the first in the order of (doc_id, text hash, line) stays and all later ones go. Neighbouring and
overlapping runs make up longer ones, so a line goes if, and only if, it lies in a run of RUN_WORDS words or more
that stands earlier too, from whichever earlier places its parts come. Blank lines inside such a run go with it. A
line that goes always has an equal line that stays, earlier in that order.

A fingerprint or run with any number of places gives one row for each, never pairs among them. Lines are compared
without white space at their ends. Null text stays null; empty texts and lines without words are never a match.
Rows with equal doc_id and text are one document and lose the same lines. A null doc_id counts as the smallest. An
empty table gives an empty result. Of the columns only ``doc_id`` and ``text`` are read; columns of any other name
are handed on, but those named ``removed_lines`` and ``removed_words`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.llm.common import bounded, drop, fresh_names, join_by_key, save, table

GRAM_WORDS, WINDOW_WORDS = 15, 11
_WORD = r"[^\x20\x09-\x0D]+"
_EDGES = " \t\n\r\x0b\x0c"


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))


def _hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def lines_of(docs: DataFrame) -> DataFrame:
    """did, th (hash of the text), line (index in the text), h (hash of the line), words; lines with a word only."""
    # The hash is taken below the explosion, once for each text.
    whole = docs.select(_id().alias("did"), _hash().alias("th"), F.split(F.col("text").cast("string"), "\n").alias("lines"))
    rows = whole.select("did", "th", F.posexplode("lines").alias("line", "own"))
    rows = rows.select("did", "th", "line", F.btrim("own", F.lit(_EDGES)).alias("own")).where("own <> ''")
    # Most lines have single spaces only, and one word more than spaces.
    single = F.octet_length("own") - F.octet_length(F.replace("own", F.lit(" "), F.lit(""))) + 1
    words = F.when(F.col("own").rlike(r"\x20\x20|[\x09-\x0D]"), F.regexp_count("own", F.lit(_WORD))).otherwise(single)
    rows = rows.select("did", "th", "line", F.xxhash64("own").alias("h"), words.cast("long").alias("words"))
    return rows.dropDuplicates(["did", "th", "line"])


def runs_of(lines: DataFrame, gram: int, window: int) -> DataFrame:
    """did, th, l1, l2 (first and last line), w1, w2 (words before the run, and before what follows), g (the fingerprint), gw (words before it), r (hash of the run).

    A row for each shortest run of gram + window - 1 words or more from a line on, and up to a line.
    """
    run = gram + window - 1
    doc = W.partitionBy("did", "th")
    ahead = lambda n: doc.orderBy("w1").rangeBetween(0, n - 1)
    at = lines.withColumn("w2", F.sum("words").over(doc.orderBy("line"))).withColumn("w1", F.col("w2") - F.col("words"))
    # A line's own gram may be cut off by the text's end; a window that lies in a run has none of these.
    grams = at.select("*", F.xxhash64(F.collect_list("h").over(ahead(gram))).alias("g"), F.collect_list("h").over(ahead(run)).alias("hs"), F.max("line").over(ahead(run)).alias("fl"), F.max("w2").over(ahead(run)).alias("fw"))
    least = grams.withColumn("x", F.min(F.struct("g", F.col("w1").alias("gw"))).over(ahead(window)))
    back = doc.orderBy("w2").rangeBetween(1 - run, 0)
    both = least.select("*", *[F.first(c).over(back).alias(f"b_{c}") for c in ("line", "w1", "fl", "x")], F.collect_list("h").over(back).alias("b_hs"))
    forward = F.struct(F.col("line").alias("l1"), F.col("fl").alias("l2"), "w1", F.col("fw").alias("w2"), "x", F.xxhash64("hs").alias("r"))
    backward = F.struct(F.col("b_line").alias("l1"), F.col("line").alias("l2"), F.col("b_w1").alias("w1"), "w2", F.col("b_x").alias("x"), F.xxhash64("b_hs").alias("r"))
    own = F.array(F.when(F.col("fw") - F.col("w1") >= run, forward), F.when((F.col("w2") - F.col("b_w1") >= run) & (F.col("b_fl") != F.col("line")), backward))
    return both.select("did", "th", F.explode(own).alias("o")).where("o is not null").select("did", "th", "o.l1", "o.l2", "o.w1", "o.w2", "o.x.g", "o.x.gw", "o.r")


def repeated_lines(runs: DataFrame, shared: DataFrame, first: DataFrame) -> DataFrame:
    """did, th, ranges (first and last line of each run to delete, in order, apart), words (that these have)."""
    later = join_by_key(join_by_key(runs, shared, ["g"]).drop("n"), first, ["g", "r"]).where(F.struct("did", "th", "w1") > F.col("s"))
    before = W.partitionBy("did", "th").orderBy("w1", "w2")
    reach = F.max("w2").over(before.rowsBetween(W.unboundedPreceding, -1))
    apart = later.select("did", "th", "l1", "l2", "w1", "w2", F.coalesce((F.col("w1") > reach).cast("int"), F.lit(1)).alias("fresh"))
    islands = apart.withColumn("island", F.sum("fresh").over(before)).groupBy("did", "th", "island")
    merged = islands.agg(F.min("l1").alias("l1"), F.max("l2").alias("l2"), (F.max("w2") - F.min("w1")).alias("words"))
    return merged.groupBy("did", "th").agg(F.sort_array(F.collect_list(F.struct("l1", "l2"))).alias("ranges"), F.sum("words").alias("words"))


def shared_fingerprints(runs: DataFrame) -> DataFrame:
    """g, n (runs that have it): fingerprints that stand at more than one place."""
    place = F.xxhash64("did", "th", "gw")
    return runs.groupBy("g").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("n")).where("lo < hi").select("g", "n")


def first_runs(runs: DataFrame, shared: DataFrame) -> DataFrame:
    """g, r, s (did, th, w1 of the first place), n: runs with a shared fingerprint that stand more than once."""
    met = join_by_key(runs, shared, ["g"]).drop("n")
    return met.groupBy("g", "r").agg(F.min(F.struct("did", "th", "w1")).alias("s"), F.count("*").alias("n")).where("n > 1")


def _without(lines: Column, ranges: Column) -> Column:
    """The lines outside of ranges, which are in order and apart."""
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ranges, i - 1)["l2"] + 1)
    stop = lambda i: F.coalesce(F.get(ranges, i)["l1"], F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ranges)), lambda i: F.slice(lines, start(i) + 1, stop(i) - start(i))))


def dedup_lines(docs: DataFrame, gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> DataFrame:
    """All rows and columns of docs with ``text`` replaced, and ``removed_lines`` array<int>, ``removed_words`` long."""
    spark = docs.sparkSession
    did, th, ranges, words, lines = fresh_names(docs, "did", "th", "ranges", "words", "lines")
    runs, path = save(runs_of(lines_of(docs), gram, window), "runs")
    shared = shared_fingerprints(runs).persist()  # narrow; what a lost executor held is made again from runs
    first = first_runs(runs, shared).persist()
    gone, _ = save(repeated_lines(runs, shared, first), "repeated")
    first.unpersist()
    shared.unpersist()
    drop(spark, path)
    gone = gone.select(F.col("did").alias(did), F.col("th").alias(th), F.col("ranges").alias(ranges), F.col("words").alias(words))
    joined = docs.withColumns({did: _id(), th: _hash()}).join(bounded(gone, weight=F.size(ranges)), [did, th], "left")
    # Only texts that lose lines are split.
    split = joined.withColumn(lines, F.when(F.col(ranges).isNotNull(), F.split(F.col("text").cast("string"), "\n")))
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(F.array_join(_without(F.col(lines), F.col(ranges)), "\n"))
    indexes = F.flatten(F.transform(ranges, lambda x: F.sequence(x["l1"], x["l2"])))
    added = {"removed_lines", "removed_words"}
    kept = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in added]
    return split.select(*kept, F.coalesce(indexes, F.array().cast("array<int>")).alias("removed_lines"), F.coalesce(words, F.lit(0)).cast("long").alias("removed_words"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("removed_lines").cast("long").alias("n_removed_lines"), "removed_words", F.array_join("removed_lines", ",").alias("removed_lines"), F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


# Runs meet by their whole lines, without hashes or fingerprints; doc_id tells documents apart.
OP5_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS own, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
), lines AS (
  SELECT doc_id, line, trim(own, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS own, len(regexp_extract_all(own, '[^\x20\x09-\x0D]+')) AS words FROM raw
), placed AS (
  SELECT doc_id, line, own, words, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS w2 FROM lines WHERE words > 0
), runs AS (
  SELECT doc_id, line AS l1, max(line) OVER f AS l2, w2 - words AS w1, max(w2) OVER f AS w2, list(own) OVER f AS content FROM placed
  WINDOW f AS (PARTITION BY doc_id ORDER BY w2 - words RANGE BETWEEN CURRENT ROW AND 24 FOLLOWING)
  UNION
  SELECT doc_id, min(line) OVER b, line, min(w2 - words) OVER b, w2, list(own) OVER b FROM placed
  WINDOW b AS (PARTITION BY doc_id ORDER BY w2 RANGE BETWEEN 24 PRECEDING AND CURRENT ROW)
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, w1) AS nth FROM runs WHERE w2 - w1 >= 25) WHERE nth > 1
), apart AS (
  SELECT *, coalesce(CAST(w1 > max(w2) OVER (PARTITION BY doc_id ORDER BY w1, w2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INT), 1) AS fresh FROM later
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY w1, w2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM apart
), merged AS (
  SELECT doc_id, min(l1) AS l1, max(l2) AS l2, max(w2) - min(w1) AS words FROM islands GROUP BY doc_id, island
), gone AS (
  SELECT doc_id, flatten(list(range(l1, l2 + 1) ORDER BY l1)) AS removed, CAST(sum(words) AS BIGINT) AS words FROM merged GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, coalesce(removed, []) AS removed, coalesce(words, 0) AS words,
    CASE WHEN removed IS NULL THEN text ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(removed, i - 1)), chr(10)), '') END AS text
  FROM documents d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(removed) AS n_removed_lines, words AS removed_words, array_to_string(removed, ',') AS removed_lines, length(text) AS n_chars, md5(text) AS text_md5 FROM kept
"""
