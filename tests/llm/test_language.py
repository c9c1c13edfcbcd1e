import math
import random
from collections import Counter

import numpy as np

from lexiforge.llm.language import document_frequency, fit, learn, ngrams, op3_language_id, predict, training_sample


def corpus(n, seed):
    rnd = random.Random(seed)
    parts = {"aa": ["the", "ing", "of", "th"], "bb": ["ein", "sch", "und", "ü"], "cc": ["que", "ción", "los", "ñ"]}
    return [(i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(3)) for _ in range(rnd.randint(3, 60))), lang) for i in range(n) for lang in [rnd.choice(sorted(parts))]]


def test_ngrams_are_whole_counts():
    at, counts = ngrams("abab")
    assert counts.sum() == 6 + 5 + 4 and sorted(Counter(counts.tolist()).items()) == [(1, 7), (2, 4)]


def test_held_out_accuracy_and_sparsity(spark):
    docs = spark.createDataFrame([(i, t, y, 1) for i, t, y in corpus(400, 1)], "doc_id long, text string, lang string, score int")
    model = learn(docs)
    held = spark.createDataFrame([*((i, t, "x") for i, t, _ in corpus(100, 2)), (500, None, "x"), (501, " 12 !", "x"), (None, "the thing", "x")], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(held, model).collect()}
    assert sum(got[i][0] == y for i, _, y in corpus(100, 2)) >= 98
    assert got[500] == got[501] == ("und", 0.0) and got[None][0] == "aa"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert len(model.weights) < 1 << 15


def test_document_frequency_covers_all_rows(spark):
    rows = corpus(60, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    df = document_frequency(docs)
    brute = np.zeros(1 << 16, dtype=np.int64)
    for _, t, _ in rows:
        brute[ngrams(t)[0]] += 1
    assert df[-1] == 60 and (df[:-1] == brute).all()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert learn(docs) is None and fit([("12", "en")], np.zeros(65537)) is None
    assert [r["lang_pred"] for r in predict(docs, None).collect()] == ["und", "und"]
    assert predict(docs.limit(0), None).count() == 0


def test_query(spark):
    got = op3_language_id(spark, "/root/testdata/sf0.001").where("held_out").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)


def test_every_language_is_in_the_sample(spark):
    rows = [(i, f"text {i}", f"l{i % 1100}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {lang for _, lang in training_sample(docs)} == {f"l{i}" for i in range(1100)}


def plain_features(text):
    """Hashed n-grams of a text, one at a time, with whole numbers of any size."""
    def mixed(x):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ x >> shift) * by % (1 << 64)
        return x

    codes = [ord(c) for c in f" {text.lower()} "]
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            h = n
            for c in codes[i : i + n]:
                h = (h * 0x1F123BB59E3779B1 + c) % (1 << 64)
            out[mixed(h) >> 48] += 1
    return out


def test_predictions_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, y) for i, t, y in corpus(200, 6)], "doc_id long, text string, lang string")
    model = learn(docs)
    fresh = [(i, t) for i, t, _ in corpus(40, 7)] + [(90, "the und que"), (91, "ZZZ"), (91, "ZZZ"), (92, "ñ"), (93, "the ing " * 30_000)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    for i, text in fresh:
        values = {f: (1 + math.log(c)) * model.idf[f] for f, c in plain_features(text).items()}
        norm = math.sqrt(sum(v * v for v in values.values()))
        logits = [sum(v / norm * model.weights[model.rows[f]][k] for f, v in values.items()) + model.bias[k] for k in range(3)]
        odds = [math.exp((x - max(logits)) / model.temperature) for x in logits]
        assert got[i][0] == model.languages[odds.index(max(odds))] and abs(got[i][1] - max(odds) / sum(odds)) < 1e-9


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    rows = [(None, f"text number {i}", "en") for i in range(4000)] + [(None, "the same", "en")] * 4000
    got = training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=400)
    assert 100 < len(got) < 350
