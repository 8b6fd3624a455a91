"""Queries that run as streams over files until all there is has been read, and queries on sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.operators.extract import apply_transforms
from webframe.operators.rules import Field, Rule
from webframe.plans.catalog import query, table
from webframe.plans.lineage import shared_folder
from webframe.plans.ordering import sequence_number
from webframe.plans.queries_pages import _LI, _ROOT
from webframe.sources import sinks
from webframe.sources.captures import events_as_captures, stream_captures
from webframe.streaming import jobs as J


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(df: DataFrame, name: str) -> DataFrame:
    """A table written as files, and these read as a stream."""
    spark, path = df.sparkSession, _folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _drained(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over all there is, each batch through *write*."""
    at = _folder(stream.sparkSession, "progress")
    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()


def _collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream puts out, as a table."""
    spark, path = stream.sparkSession, _folder(stream.sparkSession, "out")
    spark.createDataFrame([], stream.schema).write.parquet(path)
    kind = "append" if mode == "append" else "overwrite"
    _drained(stream, lambda batch, epoch: batch.write.mode(kind).parquet(path), mode)
    return spark.read.schema(stream.schema).parquet(path)


@query(
    """SELECT to_timestamp(floor(epoch_us(ts) / 600e6) * 600)::TIMESTAMP AS window_start, CASE WHEN event_type = 'signup' THEN 'unknown' ELSE 'application/' || event_type || '+json' END AS mime,
    count(*) AS total, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed FROM events GROUP BY 1, 2"""
)
def stream_stats(spark, sf):
    """The capture log as JSON lines, read as a stream, counted in windows of ten minutes."""
    path = _folder(spark, "log")
    events_as_captures(table(spark, sf, "events")).drop("event_type", "user_id", "value", "ts").write.json(path)
    out = _collected(J.stream_stats(stream_captures(spark, path)), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "mime", "total", "failed")


@query("SELECT DISTINCT event_type, props FROM events")
def stream_dedupe(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "props")
    return _collected(J.stream_dedupe(_stream(e, "events"), ["event_type", "props"], delay="100000 days")).select("event_type", "props")


@query("SELECT event_id::VARCHAR AS id, 200 AS status, 1500.0 AS duration_ms FROM events WHERE event_type <> 'error'")
def stream_correlate(spark, sf):
    """Requests and their ends as two streams; errors have no end."""
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    ends = e.where("event_type <> 'error'").select("id", (F.col("ts") + F.expr("interval 1500 milliseconds")).alias("end_ts"), F.lit(200).alias("status"), F.lit(False).alias("failed"))
    out = _collected(J.stream_correlate(_stream(e.select("id", "ts"), "requests"), _stream(ends, "ends"), delay="100000 days"))
    return out.where("status IS NOT NULL").select("id", "status", "duration_ms")


def _growth_series(spark, sf) -> DataFrame:
    e = sequence_number(table(spark, sf, "events"), ["user_id"], ["event_id"])
    return e.select(
        F.col("user_id").cast("bigint").alias("page_id"), (F.col("rn") - 1).cast("int").alias("round"), F.floor(F.col("value") * 10).cast("int").alias("height"),
        F.get_json_object("props", "$.k").try_cast("int").alias("nodes"),
    )


@query(
    """WITH s AS (SELECT user_id AS page_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, floor(value * 10)::INTEGER AS h, json_extract_string(props, '$.k')::INTEGER AS n FROM events),
    g AS (SELECT *, r >= 1 AND (h - lag(h) OVER w > 40 OR n - lag(n) OVER w > 3) AS grew, h - lag(h) OVER w AS step FROM s WHERE r <= 8 WINDOW w AS (PARTITION BY page_id ORDER BY r)),
    f AS (SELECT *, r >= 2 AND NOT grew AND NOT lag(grew) OVER (PARTITION BY page_id ORDER BY r) AS settled FROM g),
    a AS (SELECT page_id, min(CASE WHEN settled THEN r END) AS sr, max(r) AS er FROM f GROUP BY 1)
    SELECT a.page_id, coalesce(sr, er)::INTEGER AS rounds, CASE WHEN sr IS NOT NULL THEN 'settled' WHEN x.step > 40 THEN 'infinite' ELSE 'max_rounds' END AS reason
    FROM a JOIN f x ON x.page_id = a.page_id AND x.r = coalesce(sr, er) WHERE sr IS NOT NULL OR er = 8"""
)
def stream_growth_stop(spark, sf):
    """Load-more series as a stream whose rounds come in any order."""
    shuffled = _growth_series(spark, sf).repartition(5, F.xxhash64("round", "page_id"))
    path = _folder(spark, "series")
    shuffled.write.parquet(path)
    s = spark.readStream.schema(shuffled.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _collected(J.stream_growth_stop(s, idle=None)).select("page_id", "rounds", "reason")


@query(f"WITH {_LI} SELECT page_id, txt AS title, {_ROOT} || href AS link FROM li WHERE txt <> ''")
def extract_stream(spark, sf):
    """Extraction by a rule, batch by batch."""
    rule = Rule("nav ul > li", (Field("title", "a", None, ("strip",), True), Field("link", "a", "href", ("url",), True)))
    out = _folder(spark, "items")
    write = J.extract_batch(rule, lambda df, epoch: df.select("page_id", "title", "link").write.mode("append").parquet(out))
    _drained(_stream(table(spark, sf, "pages").repartition(4), "pages"), write)
    return spark.read.parquet(out)


@query("SELECT count(DISTINCT text) AS n, count(DISTINCT text) AS n_ids, count(DISTINCT text) AS last_id FROM documents")
def upsert_store(spark, sf):
    """The idempotent store: two overlapping writes and a replayed one keep each text once, ids without gaps."""
    path = _folder(spark, "store")
    d = table(spark, sf, "documents").select("text", F.col("doc_id").alias("seq"))
    for part in (d.where("seq % 3 <> 0"), d.where("seq % 2 = 0"), d, d):
        sinks.upsert_ignore(part, path, ["text"])
    return sinks.read_store(spark, path).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.max("id").alias("last_id"))


@query("SELECT url, count(*) AS n FROM pages WHERE url <> (SELECT min(url) FROM pages) GROUP BY url")
def write_by_url(spark, sf):
    """Rows kept in a folder per address, one address deleted."""
    path = _folder(spark, "by-url")
    pages = table(spark, sf, "pages").select("page_id", "url")
    sinks.write_by_url(pages, path)
    sinks.delete_url_group(spark, path, pages.agg(F.min("url")).first()[0])
    return spark.read.schema(pages.schema).parquet(path).groupBy("url").agg(F.count("*").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, upper(event_type) AS kind FROM events")
def json_and_unknown_steps(spark, sf):
    """``json`` gives a nested value; a step that nothing knows leaves the text as it is."""
    e = table(spark, sf, "events")
    return e.select("event_id", F.variant_get(apply_transforms("props", ("strip", "json")), "$.k", "bigint").alias("k"), apply_transforms("event_type", ("shine", "upper")).alias("kind"))
