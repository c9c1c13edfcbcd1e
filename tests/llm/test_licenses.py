import random
import re

from lexiforge.llm.licenses import PHRASES, TEMPLATES, op10_license_scan, scan


def brute(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at, labels = [], set()
    for i in range(len(words)):
        for p, v in PHRASES.items():
            p = p.split()
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(v)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(spark):
    rnd = random.Random(1)
    bits = ["mit", "MIT", "License", "license", "apache", "General", "public", "general", "é", "x", "licenses", "2", "1A", "K"]
    rows = [(i, "".join(rnd.choice(bits) + rnd.choice([" ", "\n", "-", ", ", "\t(", "_"]) for _ in range(rnd.randint(0, 30)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "..."), (None, "mit license")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, labels string, th int")
    got = {r["doc_id"]: r for r in scan(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), repr(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_templates_with_gaps_and_changes(spark):
    rnd = random.Random(2)
    noise = lambda n: " ".join(f"n{rnd.randint(0, 9999)}" for _ in range(n))
    words = TEMPLATES["mit-text"].split()
    changed = words[:40] + ["inserted"] + words[40:90] + words[92:]
    rows = [(1, f"{noise(50)} {' '.join(words)} {noise(9)}"), (2, f"{noise(5)} {' '.join(changed)}"), (3, " ".join(rnd.sample(words, len(words)))), (4, "Licensed under the\nApache License, Version 2.0."), (4, "Licensed under the\nApache License, Version 2.0."), (5, " ".join(words[:20]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["labels"], r["score"], r["spans"]) for r in scan(docs).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == 6
    assert by[1][1:3] == ("mit-notice,mit-text", 1.0) and by[1][3][0]["first"] == 50
    assert "mit-text" in by[2][1] and 0.7 <= by[2][2] <= 1
    assert "mit-text" not in by[3][1] and "mit-text" not in by[5][1]
    assert by[4][1:3] == ("apache,apache-notice", 1.0)
    assert scan(docs.limit(0)).count() == 0


def test_query(spark):
    assert op10_license_scan(spark, "/root/testdata/sf0.01").where("labels like '%gpl-notice%'").count() > 0
