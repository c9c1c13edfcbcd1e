"""Registered queries that write a table in the shared folder by a sink, read it back by a reader, and are checked by SQL on the source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import text as X
from lexiforge.operators import counts, inflection, votes
from lexiforge.plans import catalog as K
from lexiforge.plans import corpus as C
from lexiforge.plans.lineage import shared_folder
from lexiforge.sources import readers, sinks
from lexiforge.streaming import incremental

_ALL = K._ALL


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _write_csv(df: DataFrame, path: str, quoted: bool = True, partition_by: tuple[str, ...] = ()) -> None:
    options = {"header": True, "compression": "gzip", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "quote": '"' if quoted else "", "escape": '"' if quoted else "\\"}
    df.write.partitionBy(*partition_by).options(**options).csv(path)


# Readers


@K.query(f"WITH {K._CORPUS} SELECT CAST(id AS VARCHAR) AS id, author, date, source, md5(text) AS text_md5, len(tokens) AS n_tokens FROM corpus")
def read_csv_corpus(spark, d):
    """Compressed CSV with quotes and new lines in fields; the token list is a literal in a cell."""
    rows = C.corpus(spark, d)
    listed = F.concat(F.lit("['"), F.array_join("tokens", "', '"), F.lit("']"))
    cell = F.when(F.size("tokens") > 0, listed).otherwise("[]")
    path = _folder(spark, "csv")
    _write_csv(rows.select("id", "author", "date", F.col("source").alias("subreddit"), F.col("text").alias("body"), cell.alias("tokenized_text")), path)
    got = readers.read_corpus(spark, readers.corpus_files(spark, path))
    n = F.when(F.col("text").isNotNull(), F.size("tokens").cast("long"))
    return got.select("id", "author", "date", "source", F.md5("text").alias("text_md5"), n.alias("n_tokens"))


_ONE_LINE = "trim(regexp_replace(text, '[\\x00-\\x20,\"\\x7F-\\x{10FFFF}\\\\]+', ' ', 'g'))"


@K.query(f"""WITH {K._CORPUS}, plain AS (SELECT id, source, {_ONE_LINE} AS t FROM corpus) SELECT CAST(id AS VARCHAR) AS id, source, CASE WHEN id % 2 = 1 THEN concat('an open " quote ', t) ELSE concat('a "quoted", text ', t) END AS text FROM plain""")
def read_csv_fallback(spark, d):
    """Files with a quote that stays open are read without quotes; the others with them. A row more makes the quotes of such a file odd."""
    own = C.corpus(spark, d).select("id", "source", F.trim(F.regexp_replace("text", r"[\x00-\x20,\"\x7F-\x{10FFFF}\\]+", " ")).alias("t"))
    odd, even = _folder(spark, "odd"), _folder(spark, "even")
    files = max(own._jdf.rdd().getNumPartitions(), 1)  # compressed, a file is read by one task
    broken = own.where("id % 2 = 1").select("id", "source", F.concat(F.lit('an open " quote '), "t").alias("text"), F.pmod(F.xxhash64("id"), F.lit(files)).cast("int").alias("file"))
    more = broken.groupBy("file").agg(F.count("*").alias("n")).where("n % 2 = 0").select(F.lit(-1).cast("long").alias("id"), F.lit("none").alias("source"), F.lit('one more "').alias("text"), "file")
    _write_csv(broken.unionByName(more).repartition(files, "file"), odd, quoted=False, partition_by=("file",))
    _write_csv(own.where("id % 2 = 0").select("id", "source", F.concat(F.lit('a "quoted", text '), "t").alias("text")), even)
    got = readers.read_corpus_safe(spark, readers.corpus_files(spark, odd, "*/*.csv.gz") + readers.corpus_files(spark, even))
    return got.where("id <> '-1'").select("id", "source", "text")


@K.query(f"{_ALL}, d AS (SELECT token, date, count(*) AS n FROM each GROUP BY token, date) SELECT token, CAST(sum(n) AS BIGINT) AS total, count(*) AS days FROM d GROUP BY token")
def read_jsonl_counts(spark, d):
    """Token counts as JSON lines; the counts of a token are a map of dates."""
    path = _folder(spark, "counts")
    sinks.write_token_counts(counts.token_rollup(counts.term_day_counts(C.corpus(spark, d))), path)
    got = readers.read_jsonl(spark, path, "token string, counts map<string, long>")
    return got.select("token", F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("counts").cast("long").alias("days"))


@K.query(f"{_ALL} SELECT token, frequency, frequency_deduped FROM freq")
def read_tsv_frequencies(spark, d):
    path = _folder(spark, "frequencies")
    sinks.write_frequencies(C.frequencies(spark, d), path)
    got = readers.read_tsv(spark, path, ["token", "frequency", "frequency_deduped"], header=True)
    return got.select("token", F.col("frequency").cast("long").alias("frequency"), F.col("frequency_deduped").cast("long").alias("frequency_deduped"))


@K.query(f"{_ALL} SELECT DISTINCT token FROM each WHERE token NOT IN (SELECT token FROM vocab)")
def read_word_lists(spark, d):
    """Lists of one word a line, a file for each source; words already accepted are left out."""
    path = _folder(spark, "lists")
    each = C.corpus(spark, d).select("source", F.explode("tokens").alias("token")).distinct()
    each.select(F.col("token").alias("value"), "source").write.partitionBy("source").text(path)
    return readers.pending_terms(readers.word_lists(spark, path, "source=*"), C.vocabulary(spark, d))


@K.query("""SELECT DISTINCT lower(trim(concat('Page ', p_name, ' ', p_partkey))) AS token FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0""")
def read_encyclopaedia(spark, d):
    """A wiki dump: redirects, lists of pages and pages of other name spaces are left out."""
    part = C.read(spark, d, "part")
    k = F.col("p_partkey")
    title = F.concat(F.when(k % 7 == 0, "Talk:").otherwise(""), F.lit("Page "), "p_name", F.lit(" "), k.cast("string"))
    body = F.when(k % 11 == 0, F.concat(F.lit("x {{Disambiguation}} "), "p_name")).otherwise(F.col("p_name"))
    redirect = F.when(k % 5 == 0, F.struct(F.lit("Elsewhere").alias("_title")))
    path = _folder(spark, "dump")
    part.select(title.alias("title"), redirect.alias("redirect"), F.struct(F.struct(body.alias("_VALUE"), F.lit("preserve").alias("_space")).alias("text")).alias("revision")).write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return readers.encyclopaedia_titles(spark, path)


@K.query("SELECT DISTINCT lower(concat(p_name, ' ', p_partkey)) AS token FROM part WHERE p_partkey % 3 = 0")
def read_dictionary(spark, d):
    """A dictionary dump: pages that have the language's section."""
    part = C.read(spark, d, "part")
    body = F.when(F.col("p_partkey") % 3 == 0, "==English== a word").otherwise("==Other== a word")
    path = _folder(spark, "words")
    part.select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"), F.struct(F.struct(body.alias("_VALUE"), F.lit("preserve").alias("_space")).alias("text")).alias("revision")).write.format("xml").option("rowTag", "page").option("rootTag", "wiki").save(path)
    return readers.dictionary_titles(spark, path)


@K.query(f"{_ALL} SELECT token FROM freq WHERE length(token) % 3 = 0")
def read_api_replies(spark, d):
    """Replies of a dictionary service: terms with a definition before the cutoff."""
    own = C.frequencies(spark, d).select("token")
    early = F.when(F.length("token") % 3 == 0, "2011-02-03T04:05:06.789Z").otherwise("2019-02-03T04:05:06.789Z")
    path = _folder(spark, "replies")
    sinks.write_jsonl(own.select(F.col("token").alias("term"), F.array(F.struct(F.lit("no date").alias("written_on")), F.struct(early.alias("written_on"))).alias("list")), path)
    return readers.api_terms(readers.read_replies(spark, path), "2015-01-01")


# Sinks


def _tsv(spark, path, columns):
    return readers.read_tsv(spark, path, columns, header=True, least=1)


@K.query(f"{_ALL} SELECT 'ids' AS what, count(*) AS n FROM dup UNION ALL SELECT 'groups', count(*) FROM (SELECT hash FROM hashed GROUP BY hash HAVING count(*) > 1) UNION ALL SELECT 'rows', count(*) FROM hashed")
def sink_duplicates(spark, d):
    path = _folder(spark, "duplicates")
    sinks.write_duplicates(C.corpus(spark, d), path)
    ids = _tsv(spark, f"{path}/duplicate_ids", ["id", "source", "hash"]).agg(F.count("*").alias("n"))
    groups = spark.read.json(f"{path}/duplicate_groups").agg(F.count("*").alias("n"))
    stats = spark.read.json(f"{path}/duplicate_stats").select(F.col("n_rows").alias("n"))
    return ids.select(F.lit("ids").alias("what"), "n").unionByName(groups.select(F.lit("groups").alias("what"), "n")).unionByName(stats.select(F.lit("rows").alias("what"), "n"))


@K.query(f"{_ALL} SELECT 'rows_per_day' AS what, date AS name, count(*) AS n FROM corpus WHERE len(tokens) > 0 GROUP BY date UNION ALL SELECT 'tokens_per_source', source, count(DISTINCT token) FROM uniq GROUP BY source UNION ALL SELECT 'totals', 'n_rows', count(*) FROM corpus")
def sink_counts(spark, d):
    path = _folder(spark, "counts")
    rows = C.marked(spark, d)
    sinks.write_counts(rows, C.frequencies(spark, d), path)
    days = _tsv(spark, f"{path}/rows_per_day", ["name", "n"]).select(F.lit("rows_per_day").alias("what"), "name", F.col("n").cast("long").alias("n"))
    sources = _tsv(spark, f"{path}/tokens_per_source", ["name", "n", "authors"]).select(F.lit("tokens_per_source").alias("what"), "name", F.col("n").cast("long").alias("n")).where("n > 0")
    total = spark.read.json(f"{path}/totals").select(F.lit("totals").alias("what"), F.lit("n_rows").alias("name"), F.col("n_rows").alias("n"))
    return days.unionByName(sources).unionByName(total)


@K.query(f"{K.ORACLE_SQL['candidate_status']}")
def sink_funnel(spark, d):
    """The status of each token by the lists that it was written to; rejected and known words are in none, and come from the log."""
    status = K.QUERIES["candidate_status"](spark, d)
    path = _folder(spark, "funnel")
    named = status.withColumnsRenamed({c: c for c in status.columns})
    for column, fallback in (("n", F.lit(0).cast("long")), ("detail", F.lit(""))):
        if column not in named.columns:
            named = named.withColumn(column, fallback)
    status = sinks.write_funnel(named, path).select(*status.columns)
    lists = _tsv(spark, f"{path}/candidates", ["token", "n"]).select("token", F.lit("kept").alias("listed"))
    lists = lists.unionByName(_tsv(spark, f"{path}/waiting_list", ["token", "n"]).select("token", F.lit("low_freq").alias("listed")))
    joined = status.join(lists, "token", "left")
    own = F.coalesce("listed", F.when(~F.col("status").isin("kept", "low_freq"), F.col("status")))
    return joined.select(*[own.alias("status") if c == "status" else F.col(c) for c in status.columns])


@K.query(f"{_ALL}, {K._VOTES}, {K._MAJORITY} SELECT 'coverage' AS what, CAST((a <> '')::INT + (b <> '')::INT + (c <> '')::INT AS VARCHAR) AS name, count(*) AS n FROM maj GROUP BY 2 UNION ALL SELECT 'types', concat(label, ' ', vote_type), count(*) FROM maj GROUP BY 2 UNION ALL SELECT 'disagreements', 'first 200', least(200, count(*)) FROM maj WHERE vote_type IN ('majority', 'tie', 'tie_2of2')")
def sink_votes(spark, d):
    path = _folder(spark, "votes")
    sinks.write_votes(votes.majority(K._votes(spark, d), K.MODELS), K.MODELS, path)
    coverage = spark.read.json(f"{path}/coverage").select(F.lit("coverage").alias("what"), F.col("models").cast("string").alias("name"), F.col("n_tokens").alias("n"))
    types = spark.read.json(f"{path}/vote_types").select(F.lit("types").alias("what"), F.concat_ws(" ", "label", "vote_type").alias("name"), F.col("n_tokens").alias("n"))
    sample = spark.read.json(f"{path}/disagreements").agg(F.count("*").alias("n")).select(F.lit("disagreements").alias("what"), F.lit("first 200").alias("name"), "n")
    return coverage.unionByName(types).unionByName(sample)


@K.query(f"""{_ALL}, {K._INFLECT} SELECT count(*) AS neologisms, count(i.base) AS dropped, count(*) - count(i.base) AS kept, round(CAST(count(i.base) AS DOUBLE) / count(*) * CAST(100 AS DOUBLE), 2) AS pct, least(300, count(i.base)) AS mappings FROM n LEFT JOIN inf i USING (token)""")
def sink_folded(spark, d):
    path = _folder(spark, "folded")
    sinks.write_folded(inflection.fold(K._tokens(spark, d).select("token", F.lit("NEOLOGISM").alias("final_label"))), path)
    sample = spark.read.json(f"{path}/mappings").agg(F.count("*").alias("mappings"))
    return spark.read.json(f"{path}/reduction").crossJoin(F.broadcast(sample)).select("neologisms", "dropped", "kept", "pct", "mappings")  # one row each


@K.query("SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark")
def sink_vocabulary(spark, d):
    path = _folder(spark, "vocabulary")
    sinks.write_vocabulary(C.vocabulary(spark, d), path)
    return readers.read_lines(spark, f"{path}/vocabulary")


# Stages, increments


@K.query(f"{_ALL}, d AS (SELECT token, date, count(*) AS n FROM each GROUP BY token, date) SELECT token, date, n FROM d")
def incremental_counts(spark, d):
    """Two arrivals of files, counted by a stream that ends with what is there; each file is counted once."""
    rows = C.corpus(spark, d).select("id", "date", "tokens")
    base = _folder(spark, "stream")
    for half in (0, 1):
        rows.where(F.col("id") % 2 == half).drop("id").write.mode("append").parquet(f"{base}/in")
        incremental.ingest(spark, f"{base}/in", "date string, tokens array<string>", lambda batch: batch, f"{base}/out", f"{base}/checkpoint")
    return incremental.totals(spark, f"{base}/out")


@K.query(f"{_ALL}, a AS (SELECT token, date, count(*) AS n FROM each WHERE source < 's' GROUP BY token, date), b AS (SELECT token, date, count(*) AS n FROM each WHERE source >= 's' GROUP BY token, date) SELECT token, date, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY token, date")
def merged_counts(spark, d):
    """Counts of two files, each kept as a stage's table, and merged; a stage that is done isn't made again."""
    rows, base = C.corpus(spark, d), _folder(spark, "stages")
    make = {"a": lambda: counts.term_day_counts(rows.where("source < 's'")), "b": lambda: counts.term_day_counts(rows.where("source >= 's'"))}
    for name in ("a", "b", "a"):
        sinks.stage(spark, f"{base}/{name}", make[name])
    return counts.merge_counts(*[sinks.stage(spark, f"{base}/{name}", make["a"]) for name in make])


@K.query(f"{_ALL}, {K._VOTES}, {K._MAJORITY} SELECT token FROM maj WHERE label = 'NEOLOGISM' AND md5(token) >= '4'")
def verifier_queue(spark, d):
    """New words that the verifier hasn't judged yet."""
    majority = votes.majority(K._votes(spark, d), K.MODELS)
    return votes.to_verify(majority, majority.where(F.md5("token") < "4").select("token")).select("token")


@K.query(f"{_ALL}, {K._VOTES}, {K._MAJORITY}, x AS (SELECT token, left(md5(token), 1) AS h FROM maj) SELECT token, CASE WHEN h < '4' THEN 'NEOLOGISM' WHEN h < '8' THEN 'ENTITY' WHEN h < 'c' THEN 'FOREIGN' ELSE 'NONE' END AS verdict FROM x")
def verifier_parse(spark, d):
    """Replies with the label alone on a line, among other words of a line, and nowhere."""
    own = votes.majority(K._votes(spark, d), K.MODELS).select("token", F.substring(F.md5("token"), 1, 1).alias("h"))
    reply = F.when(F.col("h") < "4", F.concat("token", F.lit(": neologism"))).when(F.col("h") < "8", F.concat(F.lit("well\n"), "token", F.lit(": an entity, I think"))).when(F.col("h") < "c", F.concat(F.lit("this looks foreign to me about "), "token")).otherwise("who can say?")
    return votes.parse_verdicts(own.select("token", reply.alias("response")))


@K.query(f"{_ALL}, u AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS model, n_chars AS i, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS o FROM documents) SELECT model, count(*) AS replies, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(coalesce(sum(o), 0) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cache_read, count(*) AS cache_written FROM u GROUP BY model")
def verifier_usage(spark, d):
    docs = C.read(spark, d, "documents")
    model = F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b")
    return votes.usage(docs.select(model.alias("model"), F.col("n_chars").alias("input_tokens"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("output_tokens"), F.lit(None).cast("long").alias("cache_read"), F.lit(1).alias("cache_written")))


@K.query("SELECT doc_id, concat('u ', doc_id, ' x  y') AS author FROM documents")
def clean_authors(spark, d):
    return C.read(spark, d, "documents").select("doc_id", X.clean_author(F.concat(F.lit("u\t"), F.col("doc_id").cast("string"), F.lit("\nx\r\ny"))).alias("author"))
