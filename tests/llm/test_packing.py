import random

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiforge.llm.packing import cut, minimum_bin_slack, pack
from lexiforge.llm.tokens import ByteBpe

TOKENIZER = str(path("byte_bpe_50k.json"))


def test_ids_equal_the_library():
    own, lib = ByteBpe(TOKENIZER, limit=50), Tokenizer.from_file(TOKENIZER)
    rnd = random.Random(1)
    texts = ["", " ", "  ", "a  b", "a \n b", "\n\n x", "x ", "x  ", " x", "don't  it's", "été 日本 　 z", "a  b\x1c c", "1 22  333", "x\t y", "a!! b??  c"]
    texts += ["".join(rnd.choice(" \n\tab'1é.sx") for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    for text in texts:
        assert own.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_of_added_tokens_equal_the_library():
    own, lib, mark = ByteBpe(TOKENIZER), Tokenizer.from_file(TOKENIZER), "<|endoftext|>"
    assert own.encode(mark).tolist() == [50256]
    rnd = random.Random(2)
    parts = [mark, mark, mark[:-1], mark[1:], "<|", "|>", " ", "  ", "\n", "a", "one two", " x", "é", "'s"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(1, 9))) for _ in range(10_000)]
    assert sum(mark in t for t in texts) > 3000
    for text in texts:
        assert own.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_very_long_text_is_cut_and_none_of_it_lost(spark):
    text = "word " * 300_000
    got = pack(spark.createDataFrame([(1, text), (2, text), (2, text), (3, None)], "doc_id long, text string"), TOKENIZER)
    sums = {r["doc_id"]: (r["n"], r["rows"]) for r in got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("rows")).collect()}
    n = len(Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids) + 1
    assert sums == {1: (n, -(-n // 2048)), 2: (2 * n, 2 * -(-n // 2048)), 3: (1, 1)}


@pytest.mark.parametrize("seed", range(5))
def test_every_piece_once_and_close_to_the_bound(seed):
    rnd = random.Random(seed)
    counts = {}
    for _ in range(3000):
        n = rnd.choice([rnd.randint(1, 100), rnd.randint(1, 50)])
        counts[n] = counts.get(n, 0) + 1
    patterns = minimum_bin_slack(counts, 100)
    back = {}
    for pattern, times in patterns:
        assert sum(k * n for k, n in pattern) <= 100
        for k, n in pattern:
            back[k] = back.get(k, 0) + n * times
    assert back == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(t for _, t in patterns) <= -(-total // 100) + 5


def test_only_the_first_piece_is_short():
    assert cut(5, 10) == [(0, 5)]
    assert cut(10, 10) == [(0, 10)]
    assert cut(25, 10) == [(0, 5), (5, 10), (15, 10)]


def test_pack_is_gapless_and_round_trips(spark):
    rnd = random.Random(3)
    texts = {i: " ".join(rnd.choice(["alpha", "beta", "der", "été"]) for _ in range(rnd.randint(0, 60))) for i in range(80)}
    rows = [(i, t, "x", 1) for i, t in texts.items()] + [(80, None, "x", 1), (81, "", "x", 1), (None, "hi", "x", 1), (0, texts[0], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, task int").repartition(5)
    got = pack(docs, TOKENIZER, 32, with_ids=True).collect()
    bins = {}
    for r in got:
        assert len(r["ids"]) == r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 32
    lib = Tokenizer.from_file(TOKENIZER)
    for i in range(1, 80):
        own = sorted((r["piece"], r["ids"]) for r in got if r["doc_id"] == i)
        assert np.concatenate([x for _, x in own]).tolist() == [*lib.encode(texts[i], add_special_tokens=False).ids, 0]
    assert sum(r["doc_id"] == 0 and r["piece"] == 0 for r in got) == 2
    assert pack(docs.limit(0), TOKENIZER).count() == 0
