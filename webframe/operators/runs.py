"""Reports over crawl runs and their files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.functions.urls import url_host
from webframe.plans.ordering import sequence_number

# Words that mark a download problem, and file names ending in a digest.
DOWNLOAD_WORDS = ("下载", "插件", "download")
HASH_TAIL = r"^(.*)_[^_]*$"


def group_key(url: str = "url", kind: str = "kind") -> Column:
    u = F.coalesce(F.col(url), F.lit(""))
    return F.when(u == "", F.concat(F.lit("(no url)::"), F.col(kind))).otherwise(u)


def url_groups(runs: DataFrame, files: DataFrame) -> DataFrame:
    """One row per URL: totals, kinds, counts and last activity, newest first.

    Files are summed per run before they meet the runs, and runs per URL with
    map-side partial sums, so a URL may own any share of both tables.
    """
    per_run = files.groupBy("run_id").agg(F.count("*").alias("f_n"), F.sum("bytes").alias("f_b"))
    joined = runs.join(per_run, "run_id", "left").withColumn("group_key", group_key())
    return joined.groupBy("group_key").agg(
        F.first(F.coalesce("url", F.lit("")), ignorenulls=True).alias("url"),
        F.count("*").alias("run_count"),
        F.coalesce(F.sum("item_count"), F.lit(0)).alias("item_count"),
        F.coalesce(F.sum("f_n"), F.lit(0)).alias("file_count"),
        F.coalesce(F.sum("f_b"), F.lit(0)).alias("bytes"),
        F.sort_array(F.collect_set("kind")).alias("kinds"),
        F.max("created_at").alias("last_at"),
    ).withColumn("host", url_host("url")).orderBy(F.desc("last_at"), "group_key")


def url_group_runs(runs: DataFrame, files: DataFrame) -> DataFrame:
    """The runs of every URL with their file totals and position, newest first."""
    per_run = files.groupBy("run_id").agg(F.count("*").alias("file_count"), F.sum("bytes").alias("bytes"))
    d = runs.join(per_run, "run_id", "left").withColumn("group_key", group_key())
    d = d.withColumn("_age", -F.unix_micros(F.col("created_at").cast("timestamp")))
    out = sequence_number(d, ["group_key"], ["_age", "run_id"], "position").drop("_age")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("file_count", "bytes")})


def retry_merge(results: DataFrame, key: Sequence[str] = ("url",), attempt: str = "attempt") -> DataFrame:
    """The latest attempt of every URL."""
    rest = [c for c in results.columns if c not in key]
    return results.groupBy(*key).agg(F.max_by(F.struct(*rest), attempt).alias("r")).select(*key, "r.*")


def with_item_metadata(files: DataFrame, items: DataFrame) -> DataFrame:
    """Files with the fields of the item they came from."""
    return files.join(items, files["source_item_index"] == items["item_index"], "left").drop("item_index")


def keep_largest_by_stem(files: DataFrame, folder: Sequence[str] = ()) -> DataFrame:
    """Of files that differ only in the digest suffix keep the largest, mark the others."""
    stem = F.regexp_replace("filename", r"\.[^./]+$", "")
    base = F.when(stem.rlike(HASH_TAIL), F.regexp_extract(stem, HASH_TAIL, 1)).otherwise(stem)
    d = files.withColumn("base", base)
    ok = F.when(F.col("ok"), F.struct("size", (-F.col("file_id")).alias("tie")))
    best = d.groupBy(*folder, "base").agg(F.max(ok).alias("_best"))
    out = d.join(best, [*folder, "base"])
    keep = ~F.col("ok") | ((F.col("size") == F.col("_best.size")) & (-F.col("file_id") == F.col("_best.tie")))
    reason = F.when(~keep, F.concat(F.lit("larger version of "), F.col("_best.size").cast("string"), F.lit(" bytes kept")))
    return out.withColumn("keep", keep).withColumn("reason", reason).drop("_best")


def download_summary(files: DataFrame, order: str = "file_id") -> DataFrame:
    """ok / total per run, first error, and whether everything failed."""
    return files.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("ok"),
        F.min_by("error", F.when(~F.col("ok"), F.col(order))).alias("first_error"),
        (F.count_if("ok") == 0).alias("all_failed"),
    )


def split_errors(errors: str = "errors") -> Column:
    """``struct(core, download)`` lists of an error array."""
    is_dl = lambda e: reduce(Column.__or__, [e.contains(w) for w in DOWNLOAD_WORDS])
    return F.struct(
        F.filter(errors, lambda e: ~is_dl(e)).alias("core"), F.filter(errors, is_dl).alias("download")
    )


def run_status(runs: DataFrame) -> DataFrame:
    """Progress from the steps; status and message kind from items, errors and downloads.

    A failed download never makes a run fail.
    """
    done = F.size(F.filter("steps", lambda s: s["status"].isin("done", "skipped")))
    n = F.size("steps")
    e = split_errors()
    success = (F.col("item_count") > 0) & (F.size("_e.core") == 0)
    robots = F.exists("errors", lambda x: x.contains("robots"))
    d = runs.withColumn("_e", e)
    return d.select(
        *runs.columns,
        F.when(n > 0, F.round(done / n, 4)).otherwise(0.0).alias("progress"),
        F.when(success, "success").otherwise("failed").alias("status"),
        F.when(success & (F.col("failed_files") > 0), "done_with_missing_files")
        .when(success, "done")
        .when((F.size("errors") > 0) & robots, "robots_denied")
        .when(F.col("item_count") == 0, "no_items")
        .otherwise("partial").alias("outcome"),
        F.col("_e.download").alias("download_errors"),
    )
