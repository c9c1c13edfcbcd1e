import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm.eliasfano import EliasFano, Trie, joined, parted, scratch
from lexiforge.llm.lm import DISCOUNT, dequantise, op8_lm_scoring, quantise, score, train


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 5), (1000, 1000), (5000, 1 << 40), (3000, 1 << 62), (2000, 1 << 64)])
def test_elias_fano_round_trip_and_search(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
    own = EliasFano.unpack(EliasFano.encode(values, universe).pack())
    assert (own.all() == values).all() and (own.at(np.arange(n)) == values).all()
    x = np.concatenate([rng.integers(0, universe, 500, dtype=np.uint64), values[::7], np.array([0, universe - 1], dtype=np.uint64)])
    assert (own.rank(x) == np.searchsorted(values, x)).all()
    lo, hi = np.minimum(n, 100), np.minimum(n, 400)
    assert (own.rank(x, np.full(len(x), lo), np.full(len(x), hi)) == np.clip(np.searchsorted(values, x), lo, hi)).all()
    assert own.low.nbytes + own.high.nbytes <= n * (3 + 8 + max(0, math.log2(universe / max(n, 1)))) / 8 + 16


def test_joined():
    parts = [b"", b"abc", b"\0" * 9]
    assert [bytes(x) for x in parted(joined(parts))] == parts


def test_trie_finds_what_it_holds_and_nothing_else():
    rng = np.random.default_rng(5)
    words = np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64))
    pairs = np.unique(rng.integers(0, len(words), 5000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 2000, 5000).astype(np.uint64))
    codes, counts = rng.integers(1, 256, len(pairs)), np.arange(len(words))
    want = dict(zip(pairs.tolist(), codes.tolist(), strict=True))
    with scratch() as folder:
        trie = Trie.mapped(Trie.build(words, counts, counts % 256, pairs, codes).pack(), folder)
        r, known = trie.find_words(np.concatenate([words, words + np.uint64(1)]))
        assert (r[: len(words)] == counts).all() and known[: len(words)].all() and not known[len(words) :].any()
        x, y = rng.integers(0, len(words), 9000), rng.integers(0, 2100, 9000).astype(np.uint64)
        got = trie.find_pairs(x, y)
    assert got.tolist() == [want.get(int(p) << 32 | int(q), 0) for p, q in zip(x, y, strict=True)]


def test_quantised_probabilities():
    p = 10.0 ** -np.linspace(0, 8.9, 1000)
    back = dequantise(quantise(p))
    assert np.abs(np.log10(back / p)).max() < 0.0178 and back[0] == 1 and dequantise(np.array([0]))[0] == 0


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows, known, exact=False):
    """Scores of rows by a model of the texts ``known``, with dictionaries; exact: without quantising."""
    step = (lambda x: x) if exact else (lambda x: float(dequantise(quantise(np.array([x])))[0]))
    toks = [tokens_of(t) for t in known]
    uni = Counter(w for t in toks for w in t)
    two = Counter(p for t in toks for p in zip(t, t[1:], strict=False))
    kinds = Counter(u for u, _ in two)
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, text in rows:
        t = tokens_of(text)
        base = [(uni[w] + 1) / (n + v + 1) for w in t]
        s = math.log10(base[0])
        for u, w, p in zip(t, t[1:], base[1:], strict=False):
            if uni[u]:
                p = min(1.0, (step((two[u, w] - DISCOUNT) / uni[u]) if two[u, w] else 0.0) + step(DISCOUNT * kinds[u] / uni[u]) * p)
            s += math.log10(p)
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        out.append((i, held, len(t), sum(uni[w] > 0 for w in t), n, sum(map(math.log10, base)), s))
    return out


def made():
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["A", "a", "b", "the", "é", f"w{rnd.randint(0, 60)}"]) for _ in range(rnd.randint(0, 80)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (None, "a b"), (None, None), (3, rows[3][1]), (3, rows[3][1]), (202, "a the " * 40_000), ((1 << 62) + 1, "x y")]


KEY = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])


def held():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def check(got, want, within):
    got, want = sorted(map(tuple, got), key=KEY), sorted(want, key=KEY)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=within * w[2] + 1e-6)


@pytest.mark.parametrize("least", [1000, 1 << 60])
def test_equals_brute_force(spark, least):
    """With stand-ins for the words of most tokens, and without."""
    rows = made()
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, score double, block int").repartition(3)
    learnt = [t for i, t in rows if not zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2]
    model = train(docs.where(~held()), shards=5, least=least, sample=1)
    assert (len(model.hot) > 0) == (least == 1000)
    got = score(docs, held(), model, blocks=4).collect()
    check(got, brute(rows, learnt, exact=least == 1000), 0.02 if least == 1000 else 0.0)
    assert score(docs.limit(0), held(), model).count() == 0
    none = train(docs.where("false"), shards=2)
    assert {r["score"] for r in score(docs, held(), none, blocks=2).collect()} == {0.0}


def test_a_model_scores_texts_that_it_has_not_seen(spark):
    known = ["a b c d", "a b d c", "b a", "c c c"]
    fresh = [(i, t) for i, t in enumerate(["a b", "b c z", "z z", "d c b a", "c"])]
    model = train(spark.createDataFrame([(t,) for t in known], "text string"), shards=3)
    got = score(spark.createDataFrame(fresh, "doc_id long, text string"), held(), model, blocks=2).collect()
    check(got, brute(fresh, known), 0.0)


def test_probabilities_come_from_the_trie(spark, monkeypatch):
    """Without its answers the scores are those of the base."""
    rows = made()[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = train(docs, shards=2)
    empty = model.levels.where("false")
    assert all(r["score"] != r["base_score"] for r in score(docs, held(), model, blocks=2).collect() if r["n_tokens"] > 1)
    model.levels = empty
    assert all(r["score"] == r["base_score"] for r in score(docs, held(), model, blocks=2).collect())


def test_probabilities_add_up():
    """The scores of all words, the end and one unknown word after a context, by the formula that the tests use."""
    known = ["a b c d", "a b d c", "b a", "c c c", "a a b"]
    after = {w: brute([(0, f"a {w}")], known, exact=True)[0][6] for w in ("a", "b", "c", "d", "zz")}
    end = {w: brute([(0, f"a {w} zz")], known, exact=True)[0] for w in after}
    assert all(x < 0 for x in after.values()) and len(end) == 5
    uni = Counter(w for t in known for w in tokens_of(t))
    two = Counter(p for t in known for p in zip(tokens_of(t), tokens_of(t)[1:], strict=False))
    n, v, kinds = sum(uni.values()), len(uni), sum(u == "a" for u, _ in two)
    p = [max(two["a", w] - DISCOUNT, 0) / uni["a"] + DISCOUNT * kinds / uni["a"] * (uni[w] + 1) / (n + v + 1) for w in [*uni, "unknown"]]
    assert sum(p) == pytest.approx(1)


def test_documents_that_occur_twice_score_higher(spark):
    rnd = random.Random(4)
    text = lambda: " ".join(f"w{int(rnd.paretovariate(0.4)) % 5000}" for _ in range(60))
    once, twice = [text() for _ in range(120)], [text() for _ in range(40)]
    rows = [(i, t) for i, t in enumerate([*once, *twice, *twice])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in score(docs, held(), train(docs, shards=3), blocks=3).collect()}
    high = sorted(got[i] for i in range(120))[108]
    assert sum(got[i] > high for i in range(120, 200)) >= 60


def test_beats_the_base_on_held_out_texts(spark):
    sums = op8_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]
