import math
import random

from lexiforge.llm.toxicity import Lexicon, fit, fold, raw_score, score, training_sample


def texts(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(10, 200))]
        if toxic := i % 4 == 0:
            words[rnd.randrange(len(words))] = rnd.choice(["Zerk", "zerk!", "ZERK,", "grumpf" + word(), "grumpf"])
        else:
            words.insert(3, "no zork")
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_fold():
    assert fold("1D10T, ïdîöt a$$ n°1") == " idiot idiot a n i "
    assert fold("Іdіоt b@d ïdiot​!") == " idiot bad idiot "
    assert fold(None) == fold("") == fold("!!") == "  "


def test_learns_words_and_stems():
    rows = texts(600, 1)
    lexicon = fit([t for t, _ in rows], [y for _, y in rows])
    automaton = lexicon.automaton()
    held = texts(200, 2)
    wrong = sum((lexicon.slope * raw_score(fold(t), automaton) + lexicon.bias >= 0) != y for t, y in held)
    assert wrong <= 2, lexicon
    assert raw_score(fold("a z3rk b"), automaton) > 0


def test_exception_phrases_and_length():
    automaton = Lexicon({" kill ": 2.0}, (" kill time ",)).automaton()
    assert raw_score(fold("we kill time here"), automaton) == 0
    assert raw_score(fold("we kill it"), automaton) > raw_score(fold("we kill it " + "x " * 3000), automaton) > 0
    assert raw_score(fold("kill kill time"), automaton) < 2.0


def test_defined_results(spark):
    assert fit([], []).prior == 0.0 and fit(["a"], [1]).prior == 1.0
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (None, "x zerk", 5.0), (2, "", 5.0)], "doc_id long, text string, score double")
    lexicon = Lexicon({" zerk ": 3.0}, (), 1.0, -1.0)
    got = [(r["doc_id"], r["predicted"]) for r in score(docs, lexicon).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (2, 0), (None, 1)], key=str)
    assert score(docs.limit(0), Lexicon(prior=0.0)).count() == 0
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(50)] + [(7, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    many = spark.range(50).selectExpr("id AS doc_id", "concat('t', id) AS text", "'x' AS y")
    found, ys = training_sample(many, labels, per_label=1000)
    assert len(found) == len(ys) > 30


def test_scores_equal_brute_force(spark):
    """Every entry at every place of the folded text, one by one."""
    rows = texts(400, 3)
    lexicon = fit([t for t, _ in rows], [y for _, y in rows])
    fresh = [(i, t) for i, (t, _) in enumerate(texts(60, 4))] + [(70, "zerk no zork ZERK"), (71, "no zork"), (71, "no zork"), (72, ""), (73, None), (74, "zerk " * 50_000)]
    got = {r["doc_id"]: r for r in score(spark.createDataFrame(fresh, "doc_id long, text string"), lexicon).collect()}
    for i, text in fresh:
        folded = fold(text)
        if len(folded) > 10_000:
            total = 50_000 * sum(w for e, w in lexicon.weights.items() if " zerk ".startswith(e))
        else:
            at = lambda entry: [k for k in range(len(folded)) if folded.startswith(entry, k)]  # noqa: E731, B023
            safe = [(k, k + len(p)) for p in lexicon.exceptions for k in at(p)]
            total = sum(w for e, w in lexicon.weights.items() for k in at(e) if not any(a <= k and k + len(e) <= b for a, b in safe))
        raw = total / (1 + math.log10(1 + len(folded.split()) / 1000))
        p = 1 / (1 + math.exp(-(lexicon.slope * raw + lexicon.bias))) if lexicon.slope * raw + lexicon.bias > -700 else 0.0
        assert abs(got[i]["score"] - p) < 1e-9 and got[i]["predicted"] == int(p >= 0.5), (i, text)


def test_an_id_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (None, 1)], "doc_id long, toxic int")
    assert sorted(zip(*training_sample(docs, labels), strict=True)) == [("a", 0), ("a", 1)]
