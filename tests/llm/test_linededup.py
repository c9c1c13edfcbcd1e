import random

import pytest
from pyspark.sql import functions as F

from lexiforge.llm.common import join_by_key
from lexiforge.llm.linededup import dedup_lines, op5_line_dedup

WS = " \t\n\r\x0b\x0c"
LOW = -(1 << 63)


def brute(rows, run):
    """Lines with a word in runs of ``run`` words or more that stand earlier too, by comparing all pairs of documents on all diagonals."""
    docs = []
    for i, t in sorted({r for r in rows if r[1] is not None}):
        docs.append((i, [(n, x.strip(WS), len(x.split())) for n, x in enumerate(t.split("\n")) if x.strip(WS)]))
    gone = set()
    for a, (ka, la) in enumerate(docs):
        for b, (_, lb) in enumerate(docs[: a + 1]):
            for d in range(1 - len(lb) if a > b else 1, len(la)):
                hits = [x for x in range(max(0, d), min(len(la), len(lb) + d)) if la[x][1] == lb[x - d][1]]
                start = 0
                for k in range(1, len(hits) + 1):
                    if k == len(hits) or hits[k] != hits[k - 1] + 1:
                        if sum(la[x][2] for x in hits[start:k]) >= run:
                            gone |= {(ka, la[x][0]) for x in hits[start:k]}
                        start = k
    return gone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_repeated_runs_go_and_nothing_else(spark, seed):
    rnd = random.Random(seed)
    pool = [" ".join(f"p{k}w{j}" for j in range(rnd.randint(1, 12))) for k in range(14)]
    rows = []
    for i in range(25):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            k = rnd.randrange(14)
            lines += pool[k : k + rnd.randint(1, 5)] if rnd.random() < 0.6 else [f"u{i}x{rnd.random()} tail", "", "  "][: rnd.randint(1, 3)]
        rows.append((i, "\n".join(lines)))
    rows += [(30, None), (31, ""), (32, "\n\n"), (0, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame([(*r, "k", "l", "m", 5) for r in rows], "doc_id long, text string, th string, _lines string, `a.b` string, removed_words int")
    got = dedup_lines(docs, gram=8, window=6).collect()
    assert got[0].__fields__ == ["doc_id", "text", "th", "_lines", "a.b", "removed_lines", "removed_words"]
    assert len(got) == len(rows) and {(r["th"], r["_lines"], r["a.b"]) for r in got} == {("k", "l", "m")}
    order = [(LOW if i is None else i, t) for i, t in rows]
    gone = set()
    for r in got:
        i = LOW if r["doc_id"] is None else r["doc_id"]
        text = next(t for j, t in order if j == i)
        if text is None:
            assert r["text"] is None and not r["removed_lines"]
            continue
        lines = text.split("\n")
        own = {(i, n) for n in r["removed_lines"] if lines[n].strip(WS)}
        gone |= own
        assert r["text"] == "\n".join(x for n, x in enumerate(lines) if n not in r["removed_lines"])
        assert r["removed_words"] == sum(len(lines[n].split()) for _, n in own)
    assert gone == brute(order, 8 + 6 - 1)


def test_parts_that_come_from_different_earlier_places(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(0, 120, 3):
        six = [" ".join(f"d{i}l{j}w{k}" for k in range(rnd.randint(6, 15))) for j in range(6)]
        rows += [(i, "\n".join(six[:4])), (i + 1, "\n".join([f"own {i}", *six])), (i + 2, "\n".join([*six, f"tail {i}"]))]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == f"tail {i - 2}" for i in range(2, 120, 3))


def test_the_first_copy_stays_and_later_ones_go(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"own {i}\n{passage}\nend {i}") for i in range(40)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    assert got[0] == f"own 0\n{passage}\nend 0"
    assert all(got[i] == f"own {i}\nend {i}" for i in range(1, 40))


def test_repeats_inside_a_document_and_short_lines(spark):
    line = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{line}\nx\n {line} \n\nx\n{line}"), (2, "x\ny"), (3, "x\ny")], "doc_id long, text string")
    got = {r["doc_id"]: r["removed_lines"] for r in dedup_lines(docs).collect()}
    assert got == {1: [2, 3, 4, 5], 2: [], 3: []}  # the repeated run is line, x, line, with the blank line in it
    assert dedup_lines(docs.limit(0)).count() == 0


def test_a_very_long_text_of_one_line_takes_linear_time(spark):
    line = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "\n".join([line] * 100_000)), (2, "\n".join(f"{n}" for n in range(50_000)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in dedup_lines(docs).select("doc_id", "removed_words", F.length("text").alias("n")).collect()}
    assert got[1]["removed_words"] == 30 * 99_999 and got[1]["n"] == len(line)
    assert got[2]["removed_words"] == 0


def test_hot_keys_and_others_meet_like_in_a_plain_join(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 50 * (F.col("id") % 3)).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 0")
    got = join_by_key(rows, keyed, ["k"], broadcast_rows=0, hot_keys=20)
    assert sorted(got.collect()) == sorted(rows.join(keyed, "k").collect())


def test_query(spark):
    assert op5_line_dedup(spark, "/root/testdata/sf0.001").where("n_removed_lines > 0").count() > 0
