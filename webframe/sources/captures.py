"""Request-capture logs: JSON lines, one record per request, empty members left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.schemas import CAPTURE, WS_RECORD

_BAD = "_corrupt_record"


def _defaults(df: DataFrame) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    return df.withColumns(
        {
            "method": F.coalesce("method", F.lit("GET")),
            "resource_type": F.coalesce("resource_type", F.lit("xhr")),
            "request_headers": F.coalesce("request_headers", none),
            "response_headers": F.coalesce("response_headers", none),
            "page_url": F.coalesce("page_url", F.lit("")),
            "frame_url": F.coalesce("frame_url", F.lit("")),
            "mime_type": F.coalesce("mime_type", F.lit("")),
            "failed": F.coalesce("failed", F.lit(False)),
        }
    )


def read_captures(spark: SparkSession, path: str, keep_bad: bool = True) -> DataFrame:
    """Capture log with a fixed schema; unreadable lines are kept in ``_corrupt_record`` unless asked otherwise."""
    df = spark.read.schema(f"{CAPTURE}, {_BAD} string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", _BAD
    ).json(path)
    return _defaults(df if keep_bad else df.where(F.col(_BAD).isNull()).drop(_BAD))


def stream_captures(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same log as a stream of new files."""
    reader = spark.readStream.schema(CAPTURE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _defaults(reader.json(folder)).withColumn("ts", F.timestamp_seconds("timestamp"))


def read_sockets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WS_RECORD).json(path)


def events_as_captures(events: DataFrame) -> DataFrame:
    """An event table seen as a capture log (same columns, no bodies invented)."""
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
        F.concat(F.lit("https://app.example.com/u/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("url"),
        F.lit("GET").alias("method"),
        F.when(F.col("event_type") == "view", "document").otherwise("xhr").alias("resource_type"),
        F.concat(F.lit("https://app.example.com/u/"), F.col("user_id").cast("string")).alias("page_url"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.when(F.col("event_type") == "signup", "").otherwise(F.concat(F.lit("application/"), "event_type", F.lit("+json"))).alias("mime_type"),
        F.create_map().cast("map<string,string>").alias("response_headers"),
        F.col("props").alias("body_text"),
        (F.col("event_type") == "error").alias("failed"),
        F.col("event_type"),
        F.col("user_id"),
        F.col("value"),
        F.col("ts"),
    )
