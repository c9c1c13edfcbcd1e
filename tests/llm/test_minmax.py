import random
from functools import partial

import pytest

from lexiforge.llm import minmax
from lexiforge.llm.common import join_by_key
from lexiforge.llm.components import components
from lexiforge.llm.minmax import near_duplicates, op2_minhash_near_dedup
from lexiforge.llm.words import words_of


def brute(rows, size, percent):
    sets = []
    for i, t in rows:
        w = words_of(t)
        k = min(size, len(w))
        sets.append((i, {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if k else set()))
    root = {i: i for i, _ in sets if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((top(i), top(j)))
                root[q] = p
    return sorted((i if i is not None else -1, len(s), top(i) if i is not None else None, i is None or top(i) == i) for i, s in sets)


def corpus(seed, groups=12):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 8, 40, 120, 300]))]
        for _ in range(rnd.choice([1, 2, 5, 30 if g == 0 else 3])):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 12))):
                own[rnd.randrange(len(own))] = rnd.choice(vocab).upper()
            rows.append(" ".join(own))
    rows += ["", None, " \t\n", "one", "ONE", "two words", "two  Words"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,size", [(1, 2), (2, 2), (3, 5)])
def test_equals_brute_force(spark, seed, size, monkeypatch):
    monkeypatch.setattr(minmax, "GROUP", 3)
    if seed == 2:
        monkeypatch.setattr(minmax, "SMALL_BUCKET", 1)
    rows = [*corpus(seed), (None, "two words")]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, digest string, component_id int")
    got = near_duplicates(docs, size, 80).collect()
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2], r[3]) for r in got) == brute(rows, size, 80)


def test_chain_that_only_meets_in_the_middle(spark):
    words = [f"w{i}" for i in range(130)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 60])) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(docs, 2, 80).collect()) == [tuple(x) for x in brute(rows, 2, 80)]


def test_rows_with_one_id_and_empty_table(spark):
    docs = spark.createDataFrame([(7, "a b c"), (7, "d e f"), (3, "d e f"), (9, "a b c"), (7, "a b c")], "doc_id long, text string")
    assert {r["component_id"] for r in near_duplicates(docs, 2).collect()} == {3}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_hot_keys(spark, monkeypatch):
    """A third of all rows copies of one text, and a large group of near-copies, where no table is broadcast whole."""
    monkeypatch.setattr(minmax, "join_by_key", partial(join_by_key, broadcast_rows=0, hot_keys=20))
    monkeypatch.setattr(minmax, "SMALL_BUCKET", 2)
    monkeypatch.setattr(minmax, "FREQUENT", 5)
    near = [f"w{i}" for i in range(60)]
    rows = [*corpus(7, groups=6)]
    rows += [(1000 + i, "the very same words in all of these") for i in range(60)]
    rows += [(2000 + i, " ".join([*near[:i], f"x{i}", *near[i:]])) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in near_duplicates(docs, 2).collect()) == brute(rows, 2, 80)


def test_recall_on_small_sets(spark):
    """Pairs of sets of 4 and 5 shingles, just at the threshold: all are found."""
    rows = []
    for i in range(400):
        words = [f"p{i}w{j}" for j in range(6)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:5]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).where("not kept").count()
    assert got == 400


def test_very_long_texts(spark):
    text = " ".join(f"w{i % 90_000}" for i in range(300_000))
    rows = [(1, text), (2, text + " tail"), (3, "w1 w2"), (4, None)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {1: (90_000, 1), 2: (90_001, 1), 3: (1, 3), 4: (0, 4)}


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (20, 21), (5, 5), (30, 29), (29, 28), (28, 27), (27, 26), (26, 25)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 9: 1, 21: 20, 30: 25, 29: 25, 28: 25, 27: 25, 26: 25}


def test_query(spark):
    assert op2_minhash_near_dedup(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
