"""Operators on the request-capture log."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.functions import text as T
from webframe.functions.common import let

CAPTURE_TYPES = ("xhr", "fetch", "websocket")
TOP_MIME = 10

# Names under which a response keeps its list of records.
LIST_KEYS = ("data", "list", "items", "results", "records", "rows", "content")
MAX_GUESSED_FIELDS = 12


def parse_body(df: DataFrame, max_body: int | None = None) -> DataFrame:
    """Add ``body_json``: the text, when it is JSON worth parsing.

    With ``max_body`` texts are bounded: a body whose declared length is over the bound is blanked before parsing; a
    longer one without a declaration is parsed whole and stored head and tail.
    """
    mime = F.lower(F.coalesce("mime_type", F.lit("")))
    declared = F.try_element_at("response_headers", F.lit("content-length")).try_cast("long")
    body = F.col("body_text")
    if max_body is not None:
        body = F.when(F.coalesce(declared > max_body, F.lit(False)), "").otherwise(body)
    first = F.substring(F.ltrim(body), 1, 1)
    wanted = mime.contains("json") | (mime.isin("", "text/plain") & first.isin("{", "["))
    valid = wanted & F.try_parse_json(body).isNotNull()
    out = df.withColumn("body_json", F.when(valid, body))
    if max_body is None:
        return out
    return out.withColumn("body_text", F.when(body.isNotNull(), T.truncate_middle(body, max_body)))


def capturable(df: DataFrame, types: Sequence[str] = CAPTURE_TYPES) -> DataFrame:
    """Requests of the wanted kinds; inline data and blob addresses never count."""
    return df.where(F.col("resource_type").isin(*types) & ~F.col("url").startswith("data:") & ~F.col("url").startswith("blob:"))


def _java_syntax(pattern: str) -> str:
    """Named groups and their references as Java writes them."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def _java_regex_ok(spark: SparkSession, pattern: str) -> bool:
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False


def filter_captures(
    df: DataFrame, url_pattern: str = "", mime: str = "", status: int | None = None,
    has_json: bool | None = None, resource: str = "", limit: int | None = None,
) -> DataFrame:
    """Matching requests; with ``limit`` the newest ones, newest first.

    A pattern that is no regex is searched for as text, ignoring case.
    """
    if url_pattern:
        regex = _java_syntax(url_pattern)
        if _java_regex_ok(df.sparkSession, regex):
            df = df.where(F.col("url").rlike(regex))
        else:
            df = df.where(F.contains(F.lower("url"), F.lit(url_pattern.lower())))
    if mime:
        df = df.where(F.contains(F.lower(F.coalesce("mime_type", F.lit(""))), F.lit(mime.lower())))
    if status:
        df = df.where(F.col("status") == int(status))
    if has_json is not None:
        df = df.where(F.col("body_json").isNotNull() if has_json else F.col("body_json").isNull())
    if resource:
        df = df.where(F.col("resource_type") == resource)
    return df.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit) if limit else df


def capture_stats(df: DataFrame, sockets: DataFrame | None = None) -> DataFrame:
    """One row: totals and the ten most frequent MIME types as a map.

    Counting by MIME type first leaves one small row per type and task.
    """
    by_mime = df.groupBy(F.coalesce(F.nullif("mime_type", F.lit("")), F.lit("unknown")).alias("mime")).agg(
        F.count("*").alias("n"),
        F.count("body_json").alias("j"),
        F.count_if(F.coalesce(F.col("failed"), F.lit(False))).alias("f"),
    )
    top = by_mime.orderBy(F.desc("n"), "mime").limit(TOP_MIME).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("mime", "n")))).alias("m")
    )
    n_ws = sockets.agg(F.count("*").alias("c")).scalar() if sockets is not None else F.lit(0)
    return by_mime.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("j"), F.lit(0)).alias("with_json"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("failed"),
    ).withColumn("websockets", n_ws).withColumn("by_mime", top.scalar())


def largest_json(df: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """The record with the longest JSON body (newest key wins a tie)."""
    rows = df.where(F.col("body_json").isNotNull())
    size = F.struct(F.length("body_text").alias("n"), F.col("id"))
    return rows.groupBy(*per).agg(F.max_by(F.struct(*[c for c in df.columns if c not in per]), size).alias("r")).select(*per, "r.*")


def correlate(requests: DataFrame, responses: DataFrame, ends: DataFrame) -> DataFrame:
    """Requests with their response and end; failed requests without response are kept."""
    out = requests.join(responses, "id", "full_outer").join(ends, "id", "full_outer")
    return out.withColumn("duration_ms", F.round((F.col("end_ts") - F.col("timestamp")) * 1000, 2))


def ws_frames(sockets: DataFrame) -> DataFrame:
    """One row per frame of every connection."""
    return sockets.select("url", "page_url", "closed", F.posexplode("frames").alias("pos", "f")).select(
        "url", "page_url", "closed", "pos", "f.direction", "f.payload", "f.timestamp"
    )


def _at(body: Column, *keys: str) -> Column:
    return F.get_json_object(body, "$" + "".join(f".{k}" for k in keys))


def _member(body: Column, key: Column) -> Column:
    return F.call_function("get_json_object", body, F.concat(F.lit("$."), key))


def guess_item_path(body: Column) -> Column:
    """Where the records of a response sit, as a JSONPath."""

    def pick(b: Column) -> Column:
        out = F.when(b.startswith("["), "$[*]").when(~b.startswith("{"), "$")
        for k in LIST_KEYS:
            out = out.when(_at(b, k).startswith("["), f"$.{k}[*]")
            inner = [F.when(_at(b, k, i).startswith("["), f"$.{k}.{i}[*]") for i in LIST_KEYS]
            out = out.when(_at(b, k).startswith("{") & F.coalesce(*inner).isNotNull(), F.coalesce(*inner))
        return F.coalesce(out, first_array(b), F.lit("$"))

    def first_array(b: Column) -> Column:
        def one(k: Column) -> Column:
            v = _member(b, k)
            return F.when(v.startswith("["), F.concat(F.lit("$."), k, F.lit("[*]"))).when(
                v.startswith("{"),
                F.get(
                    F.array_compact(
                        F.transform(
                            F.json_object_keys(v),
                            lambda i: F.when(
                                _member(v, i).startswith("["),
                                F.concat(F.lit("$."), k, F.lit("."), i, F.lit("[*]")),
                            ),
                        )
                    ),
                    F.lit(0),
                ),
            )

        return F.get(F.array_compact(F.transform(F.json_object_keys(b), one)), F.lit(0))

    return let(F.trim(body), pick)


def _first_record(body: Column) -> Column:
    """The first object inside the first list of the body, at most two levels down."""

    def objects(a: Column) -> Column:
        items = F.coalesce(F.when(a.startswith("["), F.from_json(a, "array<string>")), F.array().cast("array<string>"))
        return F.filter(items, lambda e: e.startswith("{") | e.startswith("["))

    def members(o: Column) -> Column:
        return F.coalesce(
            F.when(o.startswith("{"), F.map_values(F.from_json(o, "map<string,string>"))), F.array().cast("array<string>")
        )

    level1 = F.flatten(
        F.transform(
            members(body),
            lambda v: F.concat(objects(v), F.flatten(F.transform(members(v), objects))),
        )
    )
    return F.get(F.concat(objects(body), level1), F.lit(0))


def guess_json_rule(captures: DataFrame, per: Sequence[str] = ("id",)) -> DataFrame:
    """A JSON-mode rule for every record (or for the longest body of every ``per`` group)."""
    src = captures.where(F.col("body_json").isNotNull())
    if tuple(per) != ("id",):
        src = largest_json(src, per)
    body = F.col("body_json")
    rec = src.select(*per, "url", guess_item_path(body).alias("item_selector"), _first_record(F.trim(body)).alias("_rec"))
    members = F.map_entries(F.from_json("_rec", "map<string,variant>"))
    fields = F.transform(
        F.slice(F.coalesce(members, F.array().cast("array<struct<key:string,value:variant>>")), 1, MAX_GUESSED_FIELDS),
        lambda m: F.struct(
            m["key"].alias("name"),
            F.concat(F.lit("$."), m["key"]).alias("selector"),
            F.lit(None).cast("string").alias("attribute"),
            F.array(F.when(F.schema_of_variant(m["value"]).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), "float").otherwise("strip")).alias("transform"),
        ),
    )
    return rec.select(*per, "url", F.lit("json").alias("mode"), "item_selector", fields.alias("fields"))

