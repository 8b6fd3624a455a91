"""Life cycle of extracted rows: dedupe, cap, incremental runs, merging, columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webframe.functions import text as T
from webframe.functions.urls import hostname, safe_name, url_part
from webframe.plans.ordering import sequence_number, top_per_key

# Default capacities.
MAX_ITEMS = 500
MAX_CAPTURES = 5000
MAX_EVENTS = 200
LIMIT_KEYS = ("max_items", "max_images", "max_files", "max_songs")
GROW_HEIGHT, GROW_NODES = 40, 3


def not_empty_row(df: DataFrame, cols: Sequence[str]) -> Column:
    kinds = dict(df.dtypes)
    return reduce(Column.__or__, [T.nonempty(c, kinds[c]) for c in cols])


def drop_empty_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a value in at least one of the columns."""
    return df.where(not_empty_row(df, cols))


def dedupe_first(df: DataFrame, cols: Sequence[str], order: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """First row per content hash (within ``scope``), empty rows dropped.

    ``rn = 1`` lets Spark keep one row per hash in every map task, so a value
    copied a billion times reaches the reducer once per task.
    """
    d = drop_empty_rows(df, cols).withColumn("content_hash", T.stable_hash(*cols))
    w = Window.partitionBy(*scope, "content_hash").orderBy(*order)
    return d.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedupe_any(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per content hash when it does not matter which (aggregated map-side)."""
    return drop_empty_rows(df, cols).withColumn("content_hash", T.stable_hash(*cols)).dropDuplicates(["content_hash"])


def cap_items(df: DataFrame, order: Sequence[str], n: int = MAX_ITEMS) -> DataFrame:
    return df.orderBy(*order).limit(n)


def incremental(items: DataFrame, seen: DataFrame, key: str = "content_hash") -> DataFrame:
    """Items whose hash is not in the state of earlier runs.

    The state is reduced to distinct hashes; the join strategy is Spark's
    choice by actual size, with AQE splitting a hot hash on the item side.
    """
    return items.join(seen.select(key).distinct(), key, "left_anti")


def seen_after(seen: DataFrame, new: DataFrame, capacity: int | None = None) -> DataFrame:
    """State after a run: old hashes keep their place, new ones follow; beyond a ``capacity`` the oldest fall out."""
    base = seen.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m"))
    fresh = new.groupBy("content_hash").agg(F.min("seq").alias("seq")).join(
        seen.select("content_hash").distinct(), "content_hash", "left_anti"
    )
    moved = fresh.withColumn("seq", F.col("seq") + F.lit(1) + base.scalar())
    state = seen.select("content_hash", "seq").unionByName(moved)
    return state if capacity is None else latest_n(state, capacity, ["seq"])


def latest_n(df: DataFrame, n: int, order: Sequence[str], per: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows, in total or per key."""
    newest = [F.col(c).desc() for c in order]
    if not per:
        return df.orderBy(*newest).limit(n)
    return top_per_key(df, per, newest, n).drop("rn")


def limit_source(default: int, keys: Sequence[str] = LIMIT_KEYS, run_key: str = "run_limit") -> Column:
    """``struct(limit, source)``: the run's own limit, then the keys in order, then the default."""
    tries = []
    for k in (run_key, *keys):
        value = F.col(k).try_cast("int")
        tries.append(F.when(value > 0, F.struct(value.alias("limit"), F.lit(k).alias("source"))))
    return F.coalesce(*tries, F.struct(F.lit(default).alias("limit"), F.lit("default").alias("source")))


def limit_per_run(
    items: DataFrame, limits: DataFrame, default: int, order: Sequence[str], run: str = "run_id",
    keys: Sequence[str] = LIMIT_KEYS, max_limit: int | None = None,
) -> DataFrame:
    """First rows of each run up to its own limit, with where the limit came from.

    The position is counted range by range, so one run may hold any share of
    the items.
    """
    keys = [k for k in keys if k in limits.columns]
    resolved = limits.select(run, limit_source(default, keys).alias("_l"))
    ranked = sequence_number(items, [run], order)
    out = ranked.join(resolved, run, "left").withColumn("limit_used", F.coalesce("_l.limit", F.lit(default)))
    out = out.withColumn("limit_source", F.coalesce("_l.source", F.lit("default"))).drop("_l")
    return out.where(F.col("rn") <= F.col("limit_used"))


def growth_stop(series: DataFrame, max_rounds: int = 8, page: str = "page_id") -> DataFrame:
    """Where a load-more loop stops: after two flat rounds, or at the budget.

    Rounds are consecutive, round 0 is the state before. Every row is handed to
    its own and the next two rounds and meets them by (page, round), so no page
    is ordered in one task.
    """
    spread = series.select(page, "round", "height", "nodes", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))

    def at(k: int, c: str) -> Column:
        return F.max(F.when(F.col("k") == k, F.col(c)))

    steps = spread.groupBy(page, (F.col("round") + F.col("k")).alias("round")).agg(
        *[at(k, c).alias(f"{c}{k}") for k in (0, 1, 2) for c in ("height", "nodes")]
    ).where(F.col("height0").isNotNull() & (F.col("round") <= max_rounds))
    grew = lambda a, b: ((F.col(f"height{a}") - F.col(f"height{b}")) > GROW_HEIGHT) | (
        (F.col(f"nodes{a}") - F.col(f"nodes{b}")) > GROW_NODES
    )
    steps = steps.withColumn("_grew", F.coalesce((F.col("round") >= 1) & grew(0, 1), F.lit(False))).withColumn(
        "_settled", F.coalesce((F.col("round") >= 2) & ~grew(0, 1) & ~grew(1, 2), F.lit(False))
    )
    state = F.struct("round", "height0", "nodes0", (F.col("height0") - F.col("height1")).alias("step"))
    g = steps.groupBy(page).agg(
        F.min_by(state, F.when(F.col("_settled"), F.col("round"))).alias("_s"),
        F.max_by(state, "round").alias("_e"),
        F.min_by(F.struct("height0", "nodes0"), "round").alias("_b"),
        F.min(F.when(F.col("_grew"), F.col("round"))).alias("_first"),
    )
    end = F.coalesce("_s", "_e")
    return g.withColumn("_end", end).select(
        page,
        F.col("_end.round").alias("rounds"),
        F.when(F.col("_s").isNotNull(), "settled")
        .when((F.col("_e.round") >= 3) & (F.col("_e.step") > GROW_HEIGHT), "infinite")
        .otherwise("max_rounds").alias("reason"),
        F.coalesce(F.col("_first") <= F.col("_end.round"), F.lit(False)).alias("grew"),
        F.greatest(F.lit(0), F.col("_end.height0") - F.col("_b.height0")).alias("height_gain"),
        F.greatest(F.lit(0), F.col("_end.nodes0") - F.col("_b.nodes0")).alias("node_gain"),
    )


def access_gaps(log: DataFrame, order: Sequence[str] = ("ts", "id"), least: float | None = None, url: str = "url") -> DataFrame:
    """*log* with ``host``, ``gap`` (seconds since the access of that host before it) and ``too_soon``.

    ``order`` sorts the accesses, a timestamp first. An access meets the one before it by
    (host, position), so a host with a third of the log is no hot key. The first access
    of a host has no gap. ``too_soon``: the gap is under ``least`` seconds.
    """
    host = F.when(url_part(url, "netloc") == "", "global").otherwise(url_part(url, "netloc"))
    d = sequence_number(log.withColumn("host", host), ["host"], order, "_n")
    before = d.select(F.col("host").alias("_h"), (F.col("_n") + 1).alias("_m"), F.col(order[0]).alias("_t"))
    d = d.join(before, F.col("host").eqNullSafe(F.col("_h")) & (F.col("_n") == F.col("_m")), "left")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = (micros(order[0]) - micros("_t")) / 1e6
    too_soon = F.lit(False) if least is None else F.coalesce(gap < least, F.lit(False))
    return d.select(*[F.col(f"`{c}`") for c in log.columns], "host", gap.alias("gap"), too_soon.alias("too_soon"))


def host_pace(log: DataFrame, order: Sequence[str] = ("ts", "id"), least: float = 1.0, url: str = "url") -> DataFrame:
    """Per host: accesses, shortest and mean gap in seconds, and how many accesses came under ``least`` seconds after the last."""
    return access_gaps(log, order, least, url).groupBy("host").agg(
        F.count("*").alias("accesses"), F.min("gap").alias("shortest"), F.avg("gap").alias("mean"), F.count_if("too_soon").alias("too_soon"))


def unique_names(files: DataFrame, order: Sequence[str], folder: str = "folder") -> DataFrame:
    """File name "artist - title"; equal names of a folder get " (2)", " (3)", ..."""
    artist, title = safe_name("artist", 60), safe_name("title", 80)
    stem = F.concat_ws(" - ", F.nullif(artist, F.lit("")), F.nullif(title, F.lit("")))
    ext = F.regexp_extract("filename", r"(\.[^./]+)$", 1)
    named = files.withColumn("_stem", stem).withColumn("_ext", ext)
    ranked = sequence_number(named, [folder, "_stem", "_ext"], order)
    n = F.col("rn")
    new = (
        F.when(F.col("_stem") == "", F.col("filename"))
        .when(n == 1, F.concat("_stem", "_ext"))
        .otherwise(F.concat("_stem", F.lit(" ("), n.cast("string"), F.lit(")"), "_ext"))
    )
    return ranked.withColumn("new_name", new).drop("_stem", "_ext", "rn")


def upsert_latest(base: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Base rows in place, overridden by the latest incoming row; new keys follow."""
    keys = list(keys)
    rest = [c for c in base.columns if c not in (*keys, seq)]
    newest = incoming.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), seq).alias("_new"), F.min(seq).alias("_new_seq")
    )
    old = base.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_old"), F.min(seq).alias("_old_seq"))
    last = base.agg(F.coalesce(F.max(seq), F.lit(0)).alias("m"))
    both = old.join(newest, keys, "full_outer").withColumn("_row", F.coalesce("_new", "_old"))
    place = F.coalesce(F.col("_old_seq"), F.col("_new_seq") + F.lit(1) + last.scalar())
    return both.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], place.alias(seq))


def infer_columns(
    df: DataFrame, data: str = "data", seq: str = "seq", sample: int | None = None, limit: int | None = None
) -> DataFrame:
    """Columns of a table of maps in first-seen order; of the first ``sample`` rows and ``limit`` columns only if asked.

    One small aggregate per task: the number of rows does not matter.
    """
    head = df.select(seq, data)
    head = head if sample is None else head.orderBy(seq).limit(sample)
    keys = head.select(seq, F.posexplode(F.map_keys(data)).alias("pos", "column"))
    found = keys.groupBy("column").agg(F.min(F.struct(seq, "pos")).alias("first")).orderBy("first")
    found = found if limit is None else found.limit(limit)
    return found.select("column", F.col(f"first.{seq}").alias("first_seq"), F.col("first.pos").alias("first_pos"))


def add_fields(df: DataFrame, consts: dict[str, object]) -> DataFrame:
    """Constant columns where absent; a present column is kept even when NULL."""
    new = {k: F.lit(v) for k, v in consts.items() if k not in df.columns}
    return df.withColumns(new) if new else df


def add_map_fields(df: DataFrame, consts: dict[str, str], data: str = "data") -> DataFrame:
    """The same for map items: only keys the item lacks are added."""
    extra = F.create_map(*[F.lit(str(x)) for kv in consts.items() for x in kv])
    missing = F.map_filter(extra, lambda k, v: ~F.map_contains_key(F.col(data), k))
    return df.withColumn(data, F.map_concat(F.col(data), missing))


def enrich(df: DataFrame, url: str = "url", field: str = "source_domain", crawled_at: Column | None = None) -> DataFrame:
    """Source host, and the crawl time when given, where the row has no such column."""
    out = df if field in df.columns else df.withColumn(field, hostname(url))
    if crawled_at is not None and "crawled_at" not in out.columns:
        out = out.withColumn("crawled_at", crawled_at)
    return out


def field_coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-empty count per column in one pass, as rows ``(field, filled, total)``."""
    kinds = dict(df.dtypes)
    one = df.agg(F.count("*").alias("total"), *[F.count_if(T.nonempty(c, kinds[c])).alias(c) for c in cols])
    return one.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled"), F.col("total")) for c in cols])).alias("r")
    ).select("r.*")
