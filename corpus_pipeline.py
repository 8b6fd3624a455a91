"""A corpus cleaned for training, in five stages that each work on all that the stage before kept.

1. ``toxicity``: documents scored as toxic go;
2. ``line_dedup``: later occurrences of repeated passages of three lines go;
3. ``near_duplicates``: of each group of near copies (Jaccard similarity 0.8 or
   more of five-word shingles, or SimHash neighbours) the smallest doc_id stays;
4. ``decontaminate``: documents that contain a window of a benchmark item go;
5. ``bpe``: the texts that are left, as token ids, with the text decoded from them.

All stages but the last return the columns of their input; a text that changes
has its ``n_chars`` counted anew. Documents are told apart by doc_id; where it
is repeated, its rows are kept or dropped together, except that one of exact
repeats stays after stage 3. A row without doc_id cannot name a component, so
stage 3 keeps it. Null and empty texts are documents without words, of which
stage 3 keeps one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webframe.llm import bpe, decontaminate, line_dedup, near_copies, toxicity
from webframe.llm.common import free_name
from webframe.plans.lineage import cut, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that a model of this corpus and its labels does not reject; null and empty texts stay unless nearly all labels are 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return toxicity.keep_clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without repeated passages of three lines; null texts stay null."""
    changed = F.col("n_removed") > 0
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        counted = F.when(changed, F.char_length("text")).otherwise(F.col("row.n_chars"))
        new["n_chars"] = counted.cast(docs.schema["n_chars"].dataType)
    cleaned = line_dedup.cleaned_texts(docs)
    return cleaned.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that names its component stays; of repeated rows with that id, one. Rows without id stay."""
    found = near_copies.near_copies(docs, fingerprints=True)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct()
    d = docs.join(kept, docs["doc_id"] == kept["_id"], "left_semi")
    sortable = [c for c, kind in docs.dtypes if c != "doc_id" and not kind.startswith(("map", "variant"))]
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in sortable]))
    first = free_name(docs, "_first")
    named = d.withColumn(first, place).where(F.col(first) == 1).select(*[f"`{c}`" for c in docs.columns])
    return named.union(docs.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose id names no contaminated text; null ids are one id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, items).where("contaminated").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row: number of tokens, digests of the ids and of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_decode(docs, path, ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: Stage 1 is a trained model, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder, read back, and deleted once it has been read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        kept = cut(stage(spark, docs, sf_dir))
        release(docs)
        docs = kept
    return docs
