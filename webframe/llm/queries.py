"""The registered queries of this package, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.llm import bpe, decontaminate, language, license_scan, line_dedup, secret_scan, simhash, source_audit, spelling, substring_dedup, token_counts, topk, toxicity
from webframe.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


@query(decontaminate.decontaminate_sql())
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminate(documents(spark, folder), table(spark, folder, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query()
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


@query()
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(documents(spark, folder))


@query()
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_decode(documents(spark, folder), path, ("n_tokens", "ids_sha256", "decoded_sha256"))


@query()
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, folder), path="source")
    return found.select("doc_id", "pos", "nth", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


@query(topk.top_k_sql())
def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, folder), table(spark, folder, "labels"))


@query()
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The documents have no paths: a source is read as a tree, every tenth document as its directory's licence file."""
    near, far = F.floor(F.col("doc_id") / 10), F.floor(F.col("doc_id") / 1000)
    name = F.when(F.col("doc_id") % 10 == 0, "LICENSE").otherwise(F.concat(F.lit("doc-"), F.col("doc_id")))
    docs = documents(spark, folder).select("doc_id", F.concat_ws("/", "source", far, near, name).alias("path"), "text")
    return license_scan.scan(docs).select("doc_id", "path", "license", "origin", F.round("score", 6).alias("score"), "directory")


@query(f"SELECT doc_id, n_lines, n_removed, sha256(text) AS text_sha256 FROM ({line_dedup.line_dedup_sql()})")
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(documents(spark, folder))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query(substring_dedup.dedup_windows_sql())
def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.dedup_windows(documents(spark, folder))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(documents(spark, folder))


@query(source_audit.source_audit_sql())
def op13_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.source_audit(documents(spark, folder))
