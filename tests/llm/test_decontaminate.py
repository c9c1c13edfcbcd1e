import random

import duckdb
import numpy as np
from lexiforge.llm.decontaminate import MIN_LCS, Space, answer_of, clean, contaminated, gram_times, lcs, op6_benchmark_decontamination, words_of
from pyspark.sql import functions as F


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_lcs_and_answers():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([bytes([rnd.randint(97, 101)]) for _ in range(rnd.randint(0, 30))] for _ in range(2))
        assert lcs(a, b) == plain_lcs(a, b)
    assert answer_of("What is it?\nA  big dog.") == [b"a", b"big", b"dog"]
    assert answer_of("One two. Three four.") == [b"three", b"four"] and answer_of("") == []


def made(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "and"]) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 6)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(12, 60))) + ". The answer is " + word() + " " + word()) for i in range(30)]
    docs, want = [], set()
    for d in range(200):
        text = [word() for _ in range(rnd.randint(0, 400))]
        if d % 4 == 0:
            i, own = items[rnd.randrange(30)]
            own = own.upper().split() if d % 8 else own.split()
            if d % 12 == 0:
                own = [w for n, w in enumerate(own) if n % 9 != 4]
            at = rnd.randint(0, len(text))
            text[at:at] = own
            want.add((d, i))
        docs.append((d, " ".join(text)))
    return items, docs, want


def test_recall_against_brute_force_and_no_others(spark):
    items, docs, want = made(2)
    rows = [(*r, 1.0) for r in docs] + [(900, None, 1.0), (901, "", 1.0), (None, items[3][1], 1.0), (0, docs[0][1], 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, cosine double").repartition(4)
    bench = spark.createDataFrame([*items, (77, None), (78, "..."), (79, "of the")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["lcs_share"] for r in contaminated(frame, bench, block_items=20).collect()}
    brute = {(d, i) for d, t in docs for i, x in items if plain_lcs(words_of(x), words_of(t)) >= MIN_LCS * len(words_of(x)) and len(words_of(t)) < 150}
    assert want <= got.keys() and (None, 3) in got
    assert len(brute & got.keys()) >= 0.9 * len(brute)
    assert {k for k in got if k[1] != 79} - want - {(None, 3)} <= brute
    assert contaminated(frame.limit(0), bench).count() == 0 and contaminated(frame, bench.limit(0)).count() == 0


def test_a_later_window_of_a_short_document_is_tried():
    """The first window holds some of the item's words by chance and ends within the item."""
    item = [f"w{i}" for i in range(20)]
    space = Space([(1, " ".join(item))])
    space.basis = np.eye(20, dtype=np.float32)
    space.targets = np.full((20, 1), 20**-0.5, dtype=np.float32)
    found = space.search(" ".join([*item[17:7:-1], *["x"] * 50, *item]))
    assert [(n, share) for n, _, share, *_ in found] == [(0, 1.0)]


def test_query_finds_all_verbatim_passages(spark):
    got = {(r["doc_id"], r["item_id"]) for r in op6_benchmark_decontamination(spark, "/root/testdata/sf0.01").collect()}
    docs = [(d, " ".join(t.split())) for d, t in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    want = {(d, i) for i, x in duckdb.sql("SELECT item_id, text FROM '/root/testdata/sf0.01/benchmark.parquet'").fetchall() for d, t in docs if " ".join(x.split()) in t}
    assert want and want <= got
    assert len(got) <= 1.1 * len(want)


def test_groups_of_blocks_find_the_same(spark):
    items, docs, want = made(4)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limits in ({"block_items": 5, "group_bytes": 1}, {"block_items": 5}):
        assert want <= {(r["doc_id"], r["item_id"]) for r in contaminated(frame, bench, **limits).collect()}


def test_rows_with_items_go_whatever_their_id(spark):
    items, docs, want = made(3)
    rows = [(*r, "x", "y") for r in docs] + [(None, items[5][1], "x", "y"), (None, "a clean text of words that no item has", "x", "y"), (None, None, "x", "y"), (7, None, "x", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, th string, did string")
    kept = clean(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert kept[0].__fields__ == frame.columns
    found = [(r["doc_id"], r["text"]) for r in kept]
    assert (None, items[5][1]) not in found and found.count((None, None)) == 1 and (7, None) in found
    assert (None, "a clean text of words that no item has") in found
    assert not {d for d, _ in want} & {d for d, t in found if t is not None}


def test_a_very_long_text(spark):
    items, _, _ = made(5)
    text = "x y z " * 200_000 + items[2][1] + " z y x" * 200_000
    frame = spark.createDataFrame([(1, text), (2, "x y")], "doc_id long, text string")
    got = contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["lcs_share"]) for r in got if r["lcs_share"] >= MIN_LCS] == [(1, 2, 1.0)]


def test_products_of_passages_by_both_ways():
    rnd = random.Random(6)
    space = Space([(1, " ".join(f"w{i}" for i in range(40)))])
    texts = [space.ids([f"w{rnd.randrange(60)}".encode() for _ in range(rnd.randint(0, 300))]) for _ in range(50)]
    a = np.zeros((0, 40))
    for ids in texts:
        for at in range(0, len(ids), 48):
            own = np.bincount(ids[at : at + 48][ids[at : at + 48] >= 0], minlength=40)
            a = np.vstack([a, own / np.linalg.norm(own)]) if own.any() else a
    probe = np.random.default_rng(1).standard_normal((40, 7)).astype(np.float32)
    for limit in (1 << 20, 0):
        assert np.allclose(gram_times(space.passages(iter(texts)), probe, limit), a.T @ (a @ probe), rtol=1e-4, atol=1e-3)


def test_the_space_is_fitted_on_all_documents(spark):
    """Short documents, each a single passage among many rows: in a space of all passages their cosines are those of TF-IDF."""
    rnd = random.Random(7)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(30)]
    terms = [w for _, t in items for w in t.split()]
    docs = [(d, f"{items[d % 30][1]} {' '.join(rnd.sample(terms, 15))}") for d in range(90)]
    filler = spark.range(100, 40_100).select(F.col("id").alias("doc_id"), F.concat(F.lit("w0x0 plain "), F.col("id").cast("string")).alias("text"))
    frame = spark.createDataFrame(docs, "doc_id long, text string").unionByName(filler).repartition(40)
    found = contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["cosine"] for r in found}
    df = {w: sum(w in t.split() for _, t in docs) + (40_000 if w == "w0x0" else 0) for w in terms}
    weigh = lambda t: np.array([t.split().count(w) * (np.log((1 + 40_090) / (1 + df[w])) + 1) for w in terms])
    want = {}
    for d, t in docs:
        a, b = weigh(t), weigh(items[d % 30][1])
        want[d, d % 30] = float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-3
