"""Small literal cases, property tests and files."""

import gzip
import hashlib
import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiforge.functions import text as X
from lexiforge.functions.fuzzy import delete_keys, osa_distance
from lexiforge.functions.labels import single_label
from lexiforge.functions.rules import reject_reason
from lexiforge.operators import classify, context, counts, duplicates, fuzzy, inflection, language, votes
from lexiforge.operators import vocabulary as V
from lexiforge.plans import catalog, novelty
from lexiforge.plans.lineage import cut
from lexiforge.sources import readers, sinks
from lexiforge.streaming import incremental


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_normalise(spark):
    assert one(spark, "see https://x.y/z or/bar you/me #été café  \x1c a\tb\n日本 ☂😀x", X.normalise) == "see URL oSUBREDDIT ".replace("oSUB", "o SUB") + "yo USER HASHTAG_TOKEN caf a b x"
    assert one(spark, None, X.normalise) is None


def test_token_lists(spark):
    assert one(spark, "['it\\'s', \"a b\"]", X.parse_token_list) == ["it's", "a b"]
    assert one(spark, "[]", X.parse_token_list) == one(spark, "x", X.parse_token_list) == one(spark, None, X.parse_token_list) == []


def test_reject_reasons(spark):
    want = {"hahaha": "unit", "sooo": "run", "ababa": "abab", "mmm": "tripled_start", "rhythm": "no_vowel", "aardvark": "double_vowel", "yes": "yeah", "ab": "length", "a" * 21: "length", "a1c": "not_alpha", "lorem": "filler", "the": "stop_word", "shiny": None, "neologism": None, "aaba": "double_vowel_few", "woah": "woah", "ohh": "cluster", "ohs": "oh", "tenet": None}
    rows = spark.createDataFrame([(k,) for k in want], "token string").select("token", reject_reason(F.col("token")).alias("r")).collect()
    assert {r["token"]: r["r"] for r in rows} == want


@pytest.mark.parametrize("at", [0, 60, 110])
def test_clip(spark, at):
    words = [f"w{i}" for i in range(111)]
    words[at] = "TOKEN"
    got = spark.createDataFrame([(" ".join(words), "token")], "t string, k string").select(X.clip_balanced(F.col("t"), F.col("k")).alias("b"), X.clip_window(F.col("t"), F.col("k")).alias("w")).first()
    assert len(got["b"].split()) == (109 if at == 60 else 110) if at != 60 else len(got["b"].split()) in (109, 110)
    assert "TOKEN" in got["b"] and "TOKEN" in got["w"] and got["w"].count("...") >= 1


def osa(a, b):
    """Optimal string alignment, by the plain dynamic programme."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        earlier, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], earlier[j - 2] + 1)
    return row[-1]


def test_osa_distance_equals_the_plain_programme(spark):
    import random

    rnd = random.Random(3)
    pairs = [("", ""), ("", "ab"), ("a", "a"), ("ab", "ba"), ("ca", "abc"), ("abcd", "badc"), ("abcde", "badce"), ("é x", "x é")]
    for _ in range(6000):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 8))]
        b = list(a)
        for _ in range(rnd.randint(0, 3)):
            k, i = rnd.randrange(4), rnd.randint(0, max(0, len(b) - 1))
            if k == 0:
                b.insert(i, rnd.choice("abcd"))
            elif k == 1 and b:
                del b[i]
            elif k == 2 and b:
                b[i] = rnd.choice("abcd")
            elif i + 1 < len(b):
                b[i], b[i + 1] = b[i + 1], b[i]
        pairs.append(("".join(a), "".join(b)))
    rows = spark.createDataFrame([*pairs, (None, "a")], "a string, b string").select("a", "b", osa_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert {(r["a"], r["b"], r["d"]) for r in rows} == {(a, b, min(3, osa(a, b))) for a, b in pairs} | {(None, "a", None)}


def test_osa_and_delete_keys(spark):
    assert [osa("teh", "the"), osa("ca", "abc"), osa("", "ab"), osa("kitten", "sitting")] == [1, 3, 2, 3]
    rows = spark.createDataFrame([("abc",), ("a",), ("",)], "t string").select(delete_keys(F.col("t")).alias("k")).collect()
    assert set(rows[0]["k"]) == {"abc", "bc", "ac", "ab", "a", "b", "c"} and set(rows[1]["k"]) == {"a", ""} and rows[2]["k"] == [""]


def test_typos_by_length_and_count(spark):
    tokens = spark.createDataFrame([("helol",), ("helxx",), ("exapmel",), ("hello",), ("wrold",)], "token string")
    terms = spark.createDataFrame([("hello", 500), ("example", 500), ("world", 100)], "term string, count long")
    got = {r["token"]: (r["correction"], r["distance"]) for r in fuzzy.typos(tokens, terms).collect()}
    assert got == {"helol": ("hello", 1), "exapmel": ("example", 2)}


def test_typos_of_rare_tokens(spark, tmp_path):
    """One document holds a typo, a document and its exact copy another; the right word is in 60."""
    rows = [(i, f"example {i}", "s") for i in range(60)] + [(60, "exapmle once", "s"), (61, "exampel twice here", "s"), (62, "exampel twice here", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, distance in (("typo_osa", 1), ("typo_levenshtein", 2)):
        got = {(r["token"], r["correction"], r["distance"]) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {("exapmle", "example", distance), ("exampel", "example", distance)}


def test_segment(spark):
    terms = spark.createDataFrame([("sun", 50), ("flower", 40), ("pot", 30)], "term string, count long")
    tokens = spark.createDataFrame([("sunflowerpot",), ("sunxflower",), ("pots",)], "token string")
    assert [tuple(r) for r in fuzzy.segment(tokens, terms, terms.select(F.col("term").alias("token"))).collect()] == [("sunflowerpot", "sun flower pot")]


def test_segment_with_misspelt_parts(spark):
    terms = spark.createDataFrame([("sun", 50), ("flower", 40), ("garden", 30)], "term string, count long")
    tokens = spark.createDataFrame([("sunflowergarden",), ("sunflowrgarden",), ("sunxflower",), ("flwoergardne",), ("garden",), ("qqqqqqqqqqqq",)], "token string")
    got = {tuple(r) for r in fuzzy.segment(tokens, terms, terms.select(F.col("term").alias("token")), edits=2).collect()}
    assert got == {("sunflowergarden", "sun flower garden"), ("sunflowrgarden", "sun flower garden"), ("sunxflower", "sun flower"), ("flwoergardne", "flower garden")}


def test_segment_by_a_large_dictionary(spark):
    """The words are the rarest of more than 500 000 terms."""
    terms = spark.range(500_010).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("term"), F.lit(9).cast("long").alias("count"))
    rare = spark.createDataFrame([("sun", 1), ("flower", 1)], "term string, count long")
    tokens = spark.createDataFrame([("sunflower",)], "token string")
    assert [tuple(r) for r in fuzzy.segment(tokens, terms.union(rare), rare.select(F.col("term").alias("token"))).collect()] == [("sunflower", "sun flower")]


def test_labels(spark):
    cases = {"a:NEOLOGISM": "NEOLOGISM", "x:y:entity": "ENTITY", "it is foreign": "FOREIGN", "NEOLOGISM or ENTITY": "ENTITY", "?": "UNKNOWN", "": "UNKNOWN"}
    for text, label in cases.items():
        assert one(spark, text, single_label) == label
    assert one(spark, None, single_label) == "UNKNOWN"


def test_votes(spark):
    rows = [(m, t, x) for t, own in {"p": "NNN", "q": "NNE", "r": "NEF", "s": "NN", "t": "NE", "u": "E"}.items() for m, x in zip("abc", own, strict=False)]
    names = {"N": "NEOLOGISM", "E": "ENTITY", "F": "FOREIGN"}
    frame = spark.createDataFrame([(m, t, names[x]) for m, t, x in rows], "model string, token string, label string")
    got = {r["token"]: (r["label"], r["vote_type"], r["agreement"]) for r in votes.majority(frame, ["a", "b", "c"]).collect()}
    assert got == {"p": ("NEOLOGISM", "unanimous", 3), "q": ("NEOLOGISM", "majority", 2), "r": ("NONE", "tie", 0), "s": ("NEOLOGISM", "unanimous_2of2", 2), "t": ("NONE", "tie_2of2", 0), "u": ("ENTITY", "single", 1)}


def test_inflections(spark):
    words = ["bunnies", "bunny", "places", "place", "boxes", "box", "cats", "cat", "class", "clas", "memeings", "memeing", "meme"]
    got = {r["token"]: (r["base"], r["rule"]) for r in inflection.inflections(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert got == {"bunnies": ("bunny", "ies->y"), "places": ("place", "es->base+e"), "memeings": ("memeing", "s->base"), "memeing": ("meme", "ing->base")}


def test_duplicate_patterns_and_survivors(spark):
    text = "long enough text"
    rows = spark.createDataFrame([("1", "u", "2010", "s", text), ("2", None, "2009", "t", text), ("3", "u", "2010", "s", "short"), ("4", "v", "2010", "s", "another text"), ("5", "v", "2010", "s", "another text"), ("6", "v", None, "s", None)], "id string, author string, date string, source string, text string")
    assert {(r["pattern"], r["count"]) for r in duplicates.duplicate_groups(rows).collect()} == {("different_author_different_source", 2), ("same_author_same_source", 2)}
    assert {r["id"] for r in duplicates.duplicate_ids(rows).collect()} == {"1", "5"}
    assert duplicates.drop_duplicates(rows, duplicates.duplicate_ids(rows)).count() == 4


def test_context_quota(spark):
    pool = [("a", i, "one", 20 + i) for i in range(12)] + [("b", i, "one", 20) for i in range(20)] + [("b", 50, "two", 20)] + [("c", 1, "one", 3)]
    frame = spark.createDataFrame(pool, "token string, id long, source string, tc long")
    got = {r["token"]: r["n"] for r in context.quota_pool(frame).groupBy("token").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 10, "b": 6, "c": 1}


def test_contexts_of_frequent_and_short_tokens(spark, tmp_path):
    """50 documents hold a short token and a long one, above the band that has SQL."""
    rows = [(i, f"abc frequent only{'x' * (i % 26)} {'word ' * 15}{i}", f"s{i % 2}") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    get = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["token"] for r in get("context_pool")} == {"abc", "frequent", "word"} and len(get("context_pool")) == 150
    assert len(get("context_quota")) == 30
    assert len(get("context_diverse3")) == len(get("context_diverse3_many_sources")) == 9
    assert [tuple(r) for r in get("context_totals")] == [(3, 0, 30)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contexts_read_the_documents_once_and_carry_no_texts(spark):
    """The exploded documents once for the contexts and once for the frequencies; no text is copied to each context."""
    assert plan_of(catalog.QUERIES["context_quota"](spark, "/root/testdata/sf0.001")).count("Generate explode") == 2
    plan = plan_of(catalog.QUERIES["context_diverse3"](spark, "/root/testdata/sf0.001"))
    assert not [line for line in plan.splitlines() if "Project" in line and "token#" in line and " text#" in line]


def test_diverse_by_facts(spark):
    texts = spark.createDataFrame([(i, f"s{i % 2}", f"word {'x' * (i % 4)}") for i in range(9)] + [(9, "s0", "")], "id long, source string, text string")
    places = texts.select(F.lit("word").alias("token"), "id", "source", (F.col("id") + 1).alias("place"))
    by_facts = context.diverse(context.attach_facts(places, texts), qualify=2, limit=None)
    by_texts = context.diverse(places.join(texts, ["id", "source"]), qualify=2, limit=None).drop("text")
    assert by_facts.columns == by_texts.columns and sorted(by_facts.collect()) == sorted(by_texts.collect()) and by_facts.count() == 3


def test_quota_by_rich_rows_only(spark):
    """A source of short texts only has no places beside a source with a longer one; the smaller source counts its rich rows."""
    pool = [("a", i, "short", 3) for i in range(30)] + [("a", 100 + i, "mixed", 3 + 6 * i) for i in range(5)] + [("a", 200, "other", 16)]
    frame = spark.createDataFrame(pool, "token string, id long, source string, tc long")
    got = [(r["id"], r["place"]) for r in context.quota_pool(frame).orderBy("place").collect()]
    assert got == [(104, 1), (103, 2), (102, 3), (200, 4)]


def test_sinks_compute_their_rows_once(spark, tmp_path):
    for name, write in (("funnel", lambda x, p: sinks.write_funnel(x, p)), ("votes", lambda x, p: sinks.write_votes(x, ["a"], p)), ("folded", lambda x, p: sinks.write_folded(x, p))):
        seen = spark.sparkContext.accumulator(0)

        def count(batches, seen=seen):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        rows = spark.createDataFrame([(f"t{i}", 1, "kept", "d", "NONE", "tie", 0, "", "NONE", "dropped", "b", "r") for i in range(20)], "token string, n long, status string, detail string, label string, vote_type string, agreement int, a string, final_label string, dedup_status string, base string, rule string")
        write(rows.mapInPandas(count, rows.schema), f"{tmp_path}/{name}")
        assert seen.value == 20, name


def test_partitions_do_not_matter_and_nothing_is_lost(spark):
    rows = spark.createDataFrame([(f"{i}", "u", "2010", f"s{i % 3}", f"alpha beta word{i % 7} word{i % 5}") for i in range(60)], "id string, author string, date string, source string, text string").withColumn("tokens", X.tokens(F.col("text"), pattern="[a-z0-9]+"))
    results = []
    for n in (1, 16):
        own = duplicates.mark_duplicates(rows.repartition(n), duplicates.duplicate_ids(rows.repartition(n)))
        results.append(sorted(map(tuple, counts.document_frequency(own).collect())))
    assert results[0] == results[1] and all(a >= b for _, a, b in results[0])
    vocab = spark.createDataFrame([("alpha",)], "token string")
    freq = counts.document_frequency(rows.withColumn("is_dup", F.lit(False)))
    labelled = V.candidates(freq.select("token"), vocab, freq, 5)
    assert labelled.count() == freq.count() == sum(r["n_tokens"] for r in V.funnel(labelled).collect())


def test_corpus_csv_with_empty_texts_and_nul(spark, tmp_path):
    texts = ["", None, "\0", "a\0\nb", 'a"\0b', '\0"', ' "\r\n" ', "a\0, b"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {int(r["id"]): (r["text_md5"], r["n_tokens"]) for r in catalog.QUERIES["read_csv_corpus"](spark, str(tmp_path)).collect()}
    want = {i: (None, None) if t is None else (hashlib.md5(t.encode()).hexdigest(), len(re.findall("[a-z]+", t.lower()))) for i, t in enumerate(texts)}
    assert got == want


def test_corpus_csv_with_crlf(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b'id,text\r\n1,"a ""\r\n b"\r\n2,\r\n3,""\r\n')
    got = {r["id"]: r["text"] for r in readers.read_corpus(spark, [f"{tmp_path}/x.csv"]).collect()}
    assert got == {"1": 'a "\n b', "2": None, "3": ""}


def test_corpus_csv(spark, tmp_path):
    def put(name, text):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)

    put("a_comments.csv.gz", 'id,author,date,subreddit,body\n1,u,2010-01-02T03,s,"two\nlines ""q"""\n2,u,2010,s,x,extra\n3,u\n')
    put("b_posts.csv.gz", "id,date,text,tokenized_text,body\n9,2011-01-01,hi,\"['hi']\",no\n")
    put("c.csv.gz", "id,other\n1,2\n")
    paths = readers.corpus_files(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a_comments.csv.gz", "b_posts.csv.gz", "c.csv.gz"]
    got = {r["id"]: (r["date"], r["source"], r["text"], r["tokens"]) for r in readers.read_corpus(spark, paths).collect()}
    assert got == {"1": ("2010-01-02", "s", 'two\nlines "q"', None), "3": (None, None, None, None), "9": ("2011-01-01", "b", "hi", ["hi"])}
    assert readers.corpus_files(spark, str(tmp_path / "none")) == []


def test_lists_logs_and_sinks(spark, tmp_path):
    (tmp_path / "l.txt").write_text(" One \n\n two\n")
    (tmp_path / "r.jsonl").write_text('{"token": "a", "label": "NONE"}\nbroken\n')
    (tmp_path / "x.tsv").write_text("# note\na\t1\nb\n")
    assert [r["token"] for r in readers.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["One", "two"]
    assert [tuple(r) for r in readers.read_jsonl(spark, str(tmp_path / "r.jsonl"), "token string, label string").collect()] == [("a", "NONE")]
    assert [tuple(r) for r in readers.read_tsv(spark, str(tmp_path / "x.tsv"), ["k", "v"]).collect()] == [("a", "1")]
    assert readers.result_path(spark, str(tmp_path), "m", "given") == "given" and readers.result_path(spark, str(tmp_path), "m") is None
    frame = spark.createDataFrame([("b", 1), ("a", 2)], "token string, n long")
    sinks.write_tsv(frame, str(tmp_path / "out"), order=[F.col("token")])
    assert [tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).collect()] == [("a", "2"), ("b", "1")]
    sinks.write_lines(frame, "token", str(tmp_path / "lines"), compress=True)
    assert spark.read.text(str(tmp_path / "lines")).count() == 2


def test_dumps(spark, tmp_path):
    page = lambda t, body, extra="": f"<page><title>{t}</title>{extra}<revision><text>{body}</text></revision></page>"
    (tmp_path / "d.xml").write_text("<mediawiki>" + page("Apple", "==English== x") + page("Apple (x)", "{{Disambiguation}}") + page("Talk:Apple", "==English==") + page("Appel", "y", '<redirect title="Apple"/>') + "</mediawiki>")
    assert [r["token"] for r in readers.encyclopaedia_titles(spark, str(tmp_path / "d.xml")).collect()] == ["apple"]
    assert [r["token"] for r in readers.dictionary_titles(spark, str(tmp_path / "d.xml")).collect()] == ["apple"]
    api = spark.createDataFrame([("Yeet", [("2014-05-01T10:00:00.000Z",)]), ("New", [("2020-01-01T00:00:00Z",), ("bad",)])], "term string, list array<struct<written_on:string>>")
    assert [r["token"] for r in readers.api_terms(api, "2015-01-01").collect()] == ["yeet"]


def test_language_gate(spark):
    detector = language.stop_word_detector({"german": ("der", "und"), "english": ("the",)})
    got = {r["token"]: r["foreign"] for r in language.token_gate(spark.createDataFrame([("der und",), ("the",), ("x",)], "token string"), detector).collect()}
    assert got == {"der und": True, "the": False, "x": False}


def test_classify_with_retry(spark):
    index = spark.createDataFrame([(f"t{i}", [(f"text {i}", "s")]) for i in range(25)], "token string, contexts array<struct<text:string,source:string>>")

    def model(prompts):
        out = []
        for p in prompts:
            words = [x.split()[1] for x in p.split("\n") if x.startswith("WORD:")]
            out.append("\n".join(f"{w}:NEOLOGISM" for w in words if len(words) == 1 or w != "t3"))
        return out

    got = {r["token"]: r["label"] for r in classify.classify(index, model, size=5).collect()}
    assert got == {f"t{i}": "NEOLOGISM" for i in range(25)}

    def broken(prompts):
        raise RuntimeError

    assert {r["label"] for r in classify.classify(index, broken, size=5).collect()} == {"NONE"}


def test_incremental_equals_one_run(spark, tmp_path):
    rows = spark.createDataFrame([(f"2010-01-0{1 + i % 3}", f"a b w{i % 4}") for i in range(30)], "date string, text string")
    tokens = lambda df: df.withColumn("tokens", X.tokens(F.col("text"), pattern=r"\w+"))
    for part in range(3):
        if part < 2:
            rows.where(F.abs(F.hash("text", "date")) % 2 == part).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.ingest(spark, str(tmp_path / "in"), rows.schema, tokens, str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(map(tuple, incremental.totals(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, counts.term_day_counts(tokens(rows)).collect()))


def test_whole_plan(spark):
    rows = spark.createDataFrame([(f"{i}", f"u{i % 4}", "2010", f"s{i % 3}", f"the glorping of word{'abc'[i % 3]} glorpings number " + " ".join(f"x{j}y" for j in range(i))) for i in range(30)], "id string, author string, date string, source string, text string").withColumn("tokens", X.tokens(F.col("text")))
    vocab = spark.createDataFrame([("number",)], "token string")
    tokens = novelty.candidates(rows, vocab, spark.createDataFrame([("word", 5)], "term string, count long"), novelty.Limits(min_df=20)).where("status = 'kept'").select("token")
    tokens = cut(tokens)
    assert {r["token"] for r in tokens.collect()} >= {"glorping", "glorpings"}
    labelled = novelty.label(rows, tokens, {m: (lambda prompts: ["\n".join(f"{x.split()[1]}:NEOLOGISM" for x in p.split("\n") if x.startswith("WORD:")) for p in prompts]) for m in "abc"})
    got = {r["token"]: r["dedup_status"] for r in novelty.folded(labelled).collect()}
    assert got["glorpings"] == "dropped" and got["glorping"] == "kept"


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_osa_is_a_near_metric(a, b):
    assert osa(a, b) == osa(b, a) and (osa(a, b) == 0) == (a == b) and abs(len(a) - len(b)) <= osa(a, b) <= max(len(a), len(b))


def test_detector_frame():
    assert list(language.stop_word_detector({"x": ("a",)})(pd.Series(["a b", None]))["conf"]) == [0.5, 0.0]


SHAPE_EXAMPLES = {
    "cluster": "aarrgh", "urgh": "urgh", "argh": "arrgh", "woah": "wooaah", "run": "yesss", "unit": "lalala", "abab": "ababab", "haha": "hahah", "ahha": "ahhah", "bahaha": "bahahha",
    "ugh": "eww", "yeah": "yeahs", "yes": "yees", "oh": "ohs", "mm": "mmh", "hm": "hmm", "uh": "uhm", "not_alpha": "a1b", "length": "ab", "tripled_start": "aaab", "stop_word": "the", "filler": "lorem", "no_vowel": "rhythm", "double_vowel": "eelgrass",
}


def test_rules_by_literal_examples(spark):
    from lexiforge.functions.rules import reject_reason

    words = [*SHAPE_EXAMPLES.values(), "covfefe", "selfie", "doomscroll", "hygge"]
    got = {r["t"]: r["r"] for r in spark.createDataFrame([(w,) for w in words], "t string").select("t", reject_reason(F.col("t")).alias("r")).collect()}
    assert all(got[w] for w in SHAPE_EXAMPLES.values()), {w: got[w] for w in SHAPE_EXAMPLES.values() if not got[w]}
    assert [got[w] for w in ("covfefe", "selfie", "doomscroll", "hygge")] == [None] * 4
    named = {name: got[w] for name, w in SHAPE_EXAMPLES.items()}
    assert {n for n, r in named.items() if n == r} >= {"urgh", "woah", "unit", "not_alpha", "length", "tripled_start", "stop_word", "filler", "no_vowel", "double_vowel"}, named


def test_fallback_deals_its_rows_over_files(spark, tmp_path):
    rows = [(i, f"text {i}", "s") for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = catalog.QUERIES["read_csv_fallback"](spark, str(tmp_path))
        odd = [f for f in got.inputFiles() if "/odd-" in f]
        assert len(odd) > 4 and {(int(r["id"]), r["text"]) for r in got.collect()} == {(i, ('an open " quote ' if i % 2 else 'a "quoted", text ') + t) for i, t, _ in rows}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_keys_of_whole_words(spark):
    """Words that share their first seven letters only do not meet; words two edits apart do."""
    word = lambda t: spark.createDataFrame([(t,)], "t string").select(delete_keys(F.col("t"), fuzzy.KEY_PREFIX).alias("k")).first()["k"]
    assert not set(word("abcdefghxxxx")) & set(word("abcdefghyyyy")) and set(word("abcdefghijkl")) & set(word("abcdefgihjk"))
    assert len(word("abcdefghijkl")) == 1 + 12 + 66
