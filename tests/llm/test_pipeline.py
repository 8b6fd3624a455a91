"""The pipeline's stages against brute force on a fixture, and the registered query as their composition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_text_joins import classes, fingerprint, leaks, repeated
from webframe.llm import toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, messy):
    at = tmp_path_factory.mktemp("corpus")
    passage = "\n".join(f"shared passage number {i} goes on" for i in range(5))
    rows = [(100 + i, f"own words {i} {i * 31}\n{passage}\nmore own {i * 7}") for i in range(6)]
    rows += [(200 + i, " ".join(f"base{j}" for j in range(300)) + (f" end{i}" if i % 2 else "")) for i in range(5)]
    rows += [(300, "before item word number one two three four five six seven after"), (301, "clean text of another kind")]
    rows += [(400 + i, f"some plain words {i} horrid horrid stuff {i * 3}") for i in range(40)] + [(500 + i, f"some plain words {i} good nice stuff {i * 3}") for i in range(40)]
    rows += messy
    d = spark.createDataFrame(rows, "doc_id long, text string")
    d.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(400 <= i < 500)) for i in range(100, 540)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "item word number one two three four five six seven"), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows


def test_stages_equal_brute_force(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_duplicates", "decontaminate", "bpe"]
    pairs = lambda d: [(r.doc_id, r.text) for r in d.collect()]

    model = toxicity.train(docs, spark.read.parquet(f"{at}/labels.parquet"))
    kept = stages["toxicity"](spark, docs, at)
    assert sorted(pairs(kept), key=str) == sorted([r for r in rows if model.score(r[1]) < 0.5], key=str)
    ids = {i for i, _ in pairs(kept)}
    assert len(ids & set(range(400, 440))) <= 4 and len(ids & set(range(500, 540))) >= 36  # a sample of 77 rows

    cleaned = stages["line_dedup"](spark, docs, at)
    want = repeated([r for r in rows if r[0] is not None])
    assert sorted([p for p in pairs(cleaned) if p[0] is not None], key=str) == sorted([w[:2] for w in want], key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cleaned.collect())

    single = stages["near_duplicates"](spark, docs, at)
    codes = {i: fingerprint(t) for i, t in rows if i is not None}
    group = classes(set(codes.values()))
    least = {}
    for i, c in codes.items():
        least[group[c]] = min(least.get(group[c], i), i)
    ours = sorted(i for i, _ in pairs(single) if i is not None)
    assert ours == sorted(least.values())
    assert sum(i is None for i, _ in pairs(single)) == sum(i is None for i, _ in rows)

    clean = stages["decontaminate"](spark, docs, at)
    dirty = {x[0] for x in leaks(rows, [(1, "item word number one two three four five six seven")]) if x[-1]}
    assert dirty == {300}
    assert sorted(pairs(clean), key=str) == sorted([r for r in rows if r[0] != 300], key=str)
    for stage in (kept, cleaned, single, clean):
        assert stage.columns == docs.columns
    assert stages["bpe"](spark, docs, at).count() == len(rows)


def test_query_runs_all_stages(spark, folder):
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
    got = entry.queries()["pipeline"](spark, at)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert 50 < got.count() < 80


def test_empty_documents_and_clashing_columns(spark, folder):
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").select("*", *[F.lit(c).alias(c) for c in ("_id", "_first", "covered", "n_removed", "row", "score")])
    for some in (docs.limit(0), docs.where("doc_id < 10 or doc_id is null")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, at)
            assert name == "bpe" or out.columns == docs.columns
            assert out.count() <= some.count()
    assert np.isfinite(toxicity.train(docs, spark.read.parquet(f"{at}/labels.parquet")).bias)
