"""Scans of page corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webframe.schemas import PAGES


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", max_chars: int | None = None) -> DataFrame:
    """Page corpus ``(page_id, url, html)``.

    ``max_chars`` drops oversized documents before they reach the HTML reader
    (only when a caller asks for it). A corpus stored in fewer splits than the
    cluster has cores is spread once, on the few bytes it then has; a corpus of
    normal size is read as stored, without a shuffle.
    """
    df = spark.read.schema(PAGES).format(fmt).load(path)
    if max_chars is not None:
        df = df.where(f"length(html) <= {int(max_chars)}")
    return spread(df)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a plain scan that has too few splits for the cores at hand."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < cores else df
