import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexiforge.llm.quality import MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS, N_CLASSES, base_counts, char_classes, distance, judge, references


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


@pytest.mark.parametrize("seed", range(6))
def test_base_counts_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b ", "é", "日 ", "\n", " ", "#", "<", " ", " ", "\r", "\x1c", "ab c ab c "]) for _ in range(rnd.randint(0, 40)))
        assert base_counts(text.encode()) == brute(text), repr(text)


def test_distance_and_classes():
    p = np.array([1.0, 0, 0])
    assert distance(p, np.array([[2.0, 0, 0], [0, 1, 1]])).tolist() == [0.0, 1.0]
    assert char_classes("aB1 .#~é\x01".encode()).tolist() == [1, 1, 1, 1, 1, 1, 1, 1, 1]
    assert char_classes(b"").sum() == 0 and len(char_classes(b"")) == N_CLASSES


def prose(rnd, n):
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    return " ".join(x.capitalize() if i % 9 == 0 else x for i, x in enumerate(rnd.choice(["the", "of", "and", "to", word(), word(), word(), word()]) for _ in range(n)))


def test_rejects_other_distributions_and_keeps_prose(spark):
    rnd = random.Random(2)
    good = [(i, prose(rnd, 150), "en", "x") for i in range(60)]
    bad = [(100, " ".join(f"W{rnd.randint(0, 10**6)}!!" for _ in range(150)), "en", "x"), (101, " ".join(f"x{rnd.randint(0, 10**6)}" for _ in range(150)), None, "x")]
    odd = [(200, None, None, "x"), (201, "", "en", "x"), (202, "a b " * 400, "en", "x")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, lang string, kept string").repartition(3)
    got = {r["doc_id"]: r for r in judge(docs, references(docs)).collect()}
    assert sum(got[i]["kept"] for i in range(60)) == 60, [got[i] for i in range(60) if not got[i]["kept"]][:2]
    assert not got[100]["kept"] and not got[100]["base_failed"]
    assert not got[101]["kept"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (200, 201, 202))
    empty = docs.limit(0)
    assert references(empty) == {} and judge(empty, {}).count() == 0
    assert {r["kept"] for r in judge(docs.where("doc_id < 60"), {}).collect()} == {True}


def test_references_are_whole_counts(spark):
    docs = spark.createDataFrame([(1, "The the, x", "en"), (2, "the y", "en"), (3, "der", "de"), (4, "zz", None)], "doc_id long, text string, lang string")
    refs = references(docs, common=1)
    assert refs["en"][1] == {b"the": 3, b"": 2} and refs["de"][1] == {b"der": 1, b"": 0}
    assert refs["en"][0][0] == 10 and refs["en"][0][1] == 1


def test_every_language_is_a_reference(spark):
    docs = spark.createDataFrame([(i, f"own{i} word", f"l{i}") for i in range(300)], "doc_id long, text string, lang string")
    assert set(references(docs)) == {f"l{i}" for i in range(300)}


def kind(c):
    if c.isascii():
        groups = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\t\n\x0b\x0c\r ", ".,;:'\"-()?", "#*$%&|<>", "!+/=@[\\]^_`{}~")
        return next((k for k, own in enumerate(groups) if c in own), 8)
    return 7


def words_in(text):
    return [w.lower().strip(".,;:!?()[]\"'") for w in re.findall(r"[^\x20\x09-\x0D]+", text)]


def divergence(p, q):
    """Jensen-Shannon distance of two dictionaries of counts, bin by bin."""
    a, b, out = sum(p.values()) or 1, sum(q.values()) or 1, 0.0
    for k in p.keys() | q.keys():
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        for v in (x, y):
            out += v * math.log2(2 * v / (x + y)) / 2 if v else 0
    return math.sqrt(max(out, 0))


def test_verdicts_equal_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, prose(rnd, rnd.randint(20, 300)), "en") for i in range(40)]
    rows += [(100 + i, " ".join(rnd.choice(["der", "und", "die", "xyz" + str(rnd.randint(0, 99))]) for _ in range(rnd.randint(40, 200))), "de") for i in range(30)]
    rows += [(200 + i, " ".join(rnd.choice(["##", "A1B2", "der", "the", f"q{rnd.random()}"]) for _ in range(rnd.randint(30, 120))), None) for i in range(60)]
    rows += [(300, None, "en"), (301, "", None), (302, "the", "de"), (303, rows[0][1], "en"), (303, rows[0][1], "en"), (304, " ".join(prose(rnd, 100) for _ in range(600)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r["kept"] for r in judge(docs, references(docs)).collect()}
    chars, common = {}, {}
    for lang in ("en", "de"):
        texts = [t for _, t, y in rows if y == lang and t is not None]
        chars[lang] = Counter(kind(c) for t in texts for c in t)
        counts = Counter(w for t in texts for w in words_in(t))
        top = sorted((w for w in counts if re.search(r"[^\W_]", w)), key=lambda w: (-counts[w], w.encode()))[:40]
        common[lang] = {w: counts[w] for w in top} | {"": sum(counts.values()) - sum(counts[w] for w in top)}
    seen = Counter()
    for i, text, _ in rows:
        text = text or ""
        n, own, again = brute(text)[0], Counter(kind(c) for c in text), brute(text)[4] if len(text) < 50_000 else 0
        kept = n >= 50 and 100 * again <= 50 * n
        if kept:
            over = []
            for lang in chars:
                mine = Counter(w if w in common[lang] and w else "" for w in words_in(text))
                room = lambda most, items, bins: math.sqrt(most**2 + bins / (8 * math.log(2) * items))
                c = divergence(own, chars[lang]) - room(MAX_CHAR_DISTANCE, len(text), N_CLASSES) if len(text) >= MIN_CHARS else -1
                w = divergence(mine, common[lang]) - room(MAX_WORD_DISTANCE, n, len(common[lang])) if n >= MIN_WORDS else -1
                over.append(max(c, w))
            kept = min(over) <= 0
        assert got[i] == kept, (i, over)
        seen[kept] += 1
    assert seen[True] > 20 and seen[False] > 20
