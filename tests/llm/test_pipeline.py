import random

import corpus_pipeline as pipeline
from lexiforge.llm.common import table
from lexiforge.llm.words import words_of
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_in_order_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), table(spark, SF, "documents").schema)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = [" ".join(t.split()) for t in rows.values()]
    assert len(set(texts)) == len(texts)
    items = [" ".join(r["text"].split()) for r in table(spark, SF, "benchmark").collect()]
    assert not [t for t in texts if any(i in t for i in items)]
    before = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    assert all(set(t.split("\n")) <= set(before[i].split("\n")) for i, t in rows.items())
    sets = {i: {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} for i, t in rows.items() if (w := words_of(t))}
    ids = sorted(sets)
    assert not [(a, b) for n, a in enumerate(ids) for b in ids[:n] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    packed = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(rows)
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) <= 2048 and max(a + n for a, n in own) == sum(n for _, n in own) for own in by.values())


def test_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_odd_rows_and_columns(spark):
    """Nulls, repeated rows, a very long text and columns with the names that the operators use."""
    good = [r["text"] for r in table(spark, SF, "documents").orderBy("doc_id").collect() if r["text"] and r["n_chars"] > 400][:60]
    item = next(r["text"] for r in table(spark, SF, "benchmark").orderBy("item_id").collect() if r["text"] and len(r["text"].split()) > 20)
    rows = [(i, t) for i, t in enumerate(good)] + [(None, f"{item}"), (500, item), (None, None), (501, None), (502, ""), (503, "12 34 !"), (5, good[5]), (5, good[5]), (None, good[7])]
    rows.append((600, "\n".join(f"{i} {t}" for i in range(20) for t in good)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1, [2]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, th string, `a.b` string, removed_words int, bands array<int>")
    columns = docs.columns
    out = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, out, SF).collect(), docs.schema)
        assert out.columns == columns, name
        left = {(r["doc_id"], r["text"]) for r in out.collect()}
        assert {(r["th"], r["a.b"], r["removed_words"]) for r in out.collect()} == {("x", "y", 1)}
        assert not {i for i, _ in left} & {501, 502, 503} and (None, None) not in left
    assert 500 not in {i for i, _ in left} and (None, item) not in left
    assert 600 in {i for i, _ in left}
    packed = pipeline.STAGES[-1][1](spark, out, SF)
    assert packed.count() >= out.count()


def test_decontamination_judges_by_a_space_of_all_documents(spark, tmp_path):
    """Short documents with 12 of an item's 20 words, its answer among them, and 36 of other items: too far from it, in a space of all passages."""
    rnd = random.Random(8)
    items = [[f"w{i}x{j}" for j in range(20)] for i in range(150)]
    spark.createDataFrame([(i, f"{' '.join(w[:16])}. {' '.join(w[16:])}.") for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    far = [(d, " ".join(items[d][:8] + items[d][16:] + rnd.sample([w for i, own in enumerate(items) if i != d for w in own], 36))) for d in range(60)]
    whole = [(100 + i, " ".join(w)) for i, w in enumerate(items)]
    filler = spark.range(1000, 41_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w0x0 plain "), F.col("id").cast("string")).alias("text"))
    docs = spark.createDataFrame(far + whole, "doc_id long, text string").unionByName(filler).repartition(8)
    left = {r["doc_id"] for r in pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert left == {d for d, _ in far} | set(range(1000, 41_000))
