"""Top-k search against brute force; language and toxicity models by held-out accuracy and on odd rows."""

import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from webframe.llm import language, topk, toxicity
from webframe.llm.common import held_out


def best(rows, k, every):
    usable = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in usable if i % every == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)[:k]  # noqa: B905
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("k,blocks", [(3, (2, 5)), (20, (1024, 4096))])
def test_top_k(spark, monkeypatch, k, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    rng = random.Random(k)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(40)]
    rows += [(41, None), (42, [None, 1.0]), (43, [float("nan")] * 6), (45, [float("inf")] * 6), (44, [1.0, 2.0]), (50, []), (None, [1.0] * 6), (7, rows[7][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("own")).withColumn("asks", F.lit(1))
    got = topk.top_k(table, F.col("vec_id") % 5 == 0, k)
    assert sorted(map(tuple, got.collect())) == best(rows, k, 5)


def test_top_k_of_large_numbers_and_few_rows(spark):
    rows = [(0, [1e6, -3.0]), (1, [2e6, 5e7]), (2, [9e7, 8e7])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(table, F.col("vec_id") == 0).collect())) == best(rows, 20, 10)
    assert topk.top_k(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_held_out_rows(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("out")).collect()
    assert {r.id: r.out for r in rows} == {i: crc32(str(i).encode()) % 5 == 0 for i in range(200)}


def test_language_is_learned(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark, docs, messy):
    rows = [(100 + i, "der die und " * (1 + i % 3)) for i in range(40)] + [(200 + i, "the of and " * (1 + i % 3)) for i in range(40)]
    d = docs(rows + messy, clash=True).withColumn("lang", F.when(F.col("doc_id").between(100, 199), "de").when(F.col("doc_id") >= 200, "en"))
    got = language.identify(d).collect()
    assert len(got) == len(rows + messy)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3, 9))
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert np.mean([by_id[i] == ("de" if i < 200 else "en") for i, _ in rows]) > 0.95
    bare = docs(messy).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(bare).collect()} == {"und"}
    assert language.identify(d.limit(0)).count() == 0


def test_language_grams_of_long_texts_by_pieces(monkeypatch):
    text = "Ein langer Text, in Stücken. " * 300
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "PIECE", 100)
    assert (language.gram_counts(text) == whole).all()
    assert language.gram_counts("123 !?") is None


def test_temperature_scales_scores_only():
    rng = np.random.default_rng(0)
    idf = np.ones(language.BUCKETS)
    bags = [(np.array([i % 2, 5 + int(rng.integers(3))]), np.array([1.0, 1.0])) for i in range(200)]
    model = language.fit(bags, ["a" if i % 2 else "b" for i in range(200)], idf)
    assert [model._best(*model._features(*b))[0] for b in bags[:10]] == ["b", "a"] * 5
    assert model.temperature > 0


def test_toxicity_is_learned_and_spelling_is_shared(spark):
    rng = random.Random(0)
    plain, bad = [f"wort{i}" for i in range(300)], ["horrid", "vileness"]
    def text(toxic):
        words = rng.choices(plain, k=rng.randint(5, 120))
        return " ".join(words + rng.choices(bad, k=max(1, len(words) // 30)) if toxic else words)
    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(900)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    found = {r.doc_id: r.predicted for r in toxicity.score(d, model).collect()}
    out = [(found[i], y) for i, _, y in rows if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in out]) > 0.95
    assert model.word("horridd") > model.word("wort12345") + 10


def test_toxicity_of_odd_rows(spark, docs, messy):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 13)] + [(1, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    d = docs(messy, clash=True)
    got = toxicity.toxicity(d, labels).collect()
    assert len(got) == len(messy)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    one = toxicity.toxicity(d, labels.withColumn("toxic", F.lit(0))).collect()
    assert {r.predicted for r in one} == {0}
    assert {r.predicted for r in toxicity.toxicity(d, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(d.limit(0), labels).count() == 0
    kept = toxicity.keep_clean(d, toxicity.Toxicity(np.zeros(toxicity.BUCKETS), -9.0))
    assert kept.columns == d.columns and kept.count() == len(messy)
