"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.plans.lineage import cut

#: ``crc32(doc_id) mod FOLDS`` of 0 marks the rows held out of every training.
FOLDS = 5


def saved(df: DataFrame) -> DataFrame:
    """*df*, written to the shared checkpoint folder and read back."""
    return cut(df)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def held_out(key: Column) -> Column:
    """True for the rows that no model may learn from; a null key is held out as well."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(FOLDS)) == 0, F.lit(True))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` is that on pure ASCII, and far cheaper than ``translate``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def free_name(df: DataFrame, name: str) -> str:
    """*name*, lengthened until no column of *df* has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
