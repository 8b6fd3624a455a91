"""Numbering and running sums that do not gather a key in one task.

``row_number().over(Window.partitionBy(key))`` sends all rows of a key to one
task. Here a key is cut into value ranges of its order column; positions are
counted inside a range and shifted by the counts of the ranges before it. The
shift table has at most ``ranges`` rows per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_RANGES = 64


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by *keys* over all shuffle partitions.

    A cut table's files are a fraction of its rows in memory, so tasks that follow its
    splits (or partitions merged by their compressed size) get more rows the more there are.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _range_count(df: DataFrame, ranges: int | None) -> int:
    """Ranges per key: at least 64, and as many as there are shuffle partitions."""
    return ranges or max(MIN_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _count_below(cuts: Column, value: Column, n: int) -> Column:
    """How many of the ``n`` ascending cut points lie below the value, by bisection."""
    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.get(cuts, mid) < value)
        return F.struct(
            F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, step)["lo"]


def _as_number(df: DataFrame, col: str) -> Column:
    kind = df.schema[col].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    if kind == "timestamp":
        return F.unix_micros(F.col(col)).cast("double")
    if kind == "date":
        return F.unix_date(F.col(col)).cast("double")
    return F.col(col).cast("double")


def _with_range(df: DataFrame, first: str, ranges: int) -> DataFrame:
    """Add ``_r``: index of the value range of *first*, from approximate quantiles.

    The cut points are one array of fixed size, computed as a scalar subquery of
    the same plan, so the assignment depends on the row's value only and a
    retried task computes the same range again.
    """
    number = _as_number(df, first)
    steps = [i / ranges for i in range(1, ranges)]
    cuts = df.select(number.alias("_n")).agg(F.percentile_approx("_n", steps, max(1000, 4 * ranges)).alias("c"))
    return df.withColumn("_n", number).withColumn("_cuts", cuts.scalar()).withColumn(
        "_r", F.coalesce(_count_below(F.col("_cuts"), F.col("_n"), ranges), F.lit(0))
    ).drop("_cuts", "_n")


def sequence_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", ranges: int | None = None
) -> DataFrame:
    """Exact 1-based position of every row within its key by ``order``.

    ``order[0]`` must be numeric or temporal and well spread; the other order
    columns break ties.
    """
    keys = list(keys)
    d = _with_range(df, order[0], _range_count(df, ranges))
    counts = d.groupBy(*keys, "_r").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*keys, "_r", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_r").orderBy(*order)
    local = d.withColumn("_local", F.row_number().over(inner))
    return (
        _join_on(local, shift, [*keys, "_r"])
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_r", "_local", "_before")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, ranges: int | None = None
) -> DataFrame:
    """Sum of ``value`` from the first row of the key up to and including this row."""
    keys = list(keys)
    d = _with_range(df, order[0], _range_count(df, ranges))
    sums = d.groupBy(*keys, "_r").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*keys, "_r", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = d.withColumn("_local", F.sum(value).over(inner))
    return (
        _join_on(local, shift, [*keys, "_r"])
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_r", "_local", "_before")
    )


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join that treats NULL keys as equal and keeps the left columns."""
    renamed = right.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        eq = left[k].eqNullSafe(renamed[f"_k_{k}"])
        cond = eq if cond is None else cond & eq
    return left.join(renamed, cond).drop(*[f"_k_{k}" for k in keys])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rn", salts: int = 32) -> DataFrame:
    """The first ``n`` rows of every key by ``order``, with their position.

    Small ``n``: Spark cuts every map task's input to n rows per key before the
    shuffle (window group limit). Above its threshold the same is done here in
    two steps over salted keys.
    """
    keys = list(keys)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        spread = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))]), F.lit(salts))
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", spread).withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
        df = df.drop("_salt", name)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
