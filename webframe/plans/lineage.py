"""Cutting long plans at reliable storage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_TABLES: list[str] = []


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, wherever that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_tables() -> None:
    """Delete the tables that this program has cut; runs by itself when the program ends."""
    spark = SparkSession.getActiveSession()
    while _TABLES and spark is not None:
        path = _TABLES.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            delete_path(spark, path)


def release(*tables: DataFrame) -> None:
    """Delete cut tables that nothing reads any more, before the program ends; call it when their last reader has been written."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path in _TABLES:
            _TABLES.remove(path)
            delete_path(df.sparkSession, path)


atexit.register(drop_tables)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get(SETTING, None) or sc.getConf().get(SETTING, None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="webframe-checkpoint-")
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between steps; all executors reach it."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    The table lies in the shared checkpoint folder: losing executors later
    costs no recomputation of what is above it, each later step reads only the
    columns it needs, and its plan starts from a plain scan.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    _TABLES.append(path)
    df.write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table._cut_path = path
    return table
