"""Media files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_media_files(spark: SparkSession, folder: str, glob: str | None = None, whole: bool = True) -> DataFrame:
    """``(path, size, head, content)``; without ``whole`` only the head is kept per row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(folder)
    cols = ["path", F.col("length").alias("size"), F.substring("content", 1, 4096).alias("head")]
    return df.select(*cols, *(["content"] if whole else []))
