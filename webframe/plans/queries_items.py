"""Queries on item tables, captures, runs and files."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.functions.urls import url_slug
from webframe.operators import captures as C
from webframe.operators import items as I
from webframe.operators import media as M
from webframe.operators import runs as N
from webframe.operators.extract import extract_json as items_of_json
from webframe.operators.extract import finish_rows
from webframe.operators.rules import Field, Rule
from webframe.plans.catalog import query, table
from webframe.plans.lineage import shared_folder
from webframe.plans.ordering import sequence_number
from webframe.plans.steps import Step, register_jsonpath_rows, run_steps
from webframe.sources.captures import events_as_captures, read_captures
from webframe.sources.sinks import fetch_recent as recent_rows
from webframe.sources.sinks import write_items as write
from webframe.sources.sinks import hashed_rows, new_rows, notify_payload as payload
from webframe.streaming.jobs import stats_by_window


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _events(spark, sf):
    return table(spark, sf, "events")


def _captures(spark, sf):
    return C.parse_body(events_as_captures(_events(spark, sf)))


@query("SELECT min(doc_id) AS doc_id, lang FROM documents WHERE text <> '' OR lang <> '' GROUP BY text, lang")
def dedupe_first(spark, sf):
    return I.dedupe_first(_docs(spark, sf), ["text", "lang"], ["doc_id"]).select("doc_id", "lang")


@query("SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY text, source")
def dedupe_per_source(spark, sf):
    return I.dedupe_first(_docs(spark, sf), ["text"], ["doc_id"], ["source"]).select("doc_id", "source")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text ORDER BY 1 LIMIT 500")
def cap_items(spark, sf):
    return I.cap_items(I.dedupe_first(_docs(spark, sf), ["text"], ["doc_id"]), ["doc_id"]).select("doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en') GROUP BY text")
def incremental(spark, sf):
    items = I.dedupe_first(_docs(spark, sf), ["text"], ["doc_id"])
    seen = hashed_rows(_docs(spark, sf).where("lang = 'en'"), ["text"])
    return I.incremental(items, seen).select("doc_id")


@query(
    """WITH s AS (SELECT md5(text) AS h, min(doc_id) AS seq FROM documents WHERE lang = 'en' GROUP BY 1), n AS (SELECT md5(text) AS h, min(doc_id) AS seq FROM documents WHERE lang <> 'en' GROUP BY 1)
    SELECT h AS content_hash, seq FROM (SELECT h, seq FROM s UNION ALL SELECT h, seq + 1 + (SELECT max(seq) FROM s) FROM n WHERE h NOT IN (SELECT h FROM s))"""
)
def seen_state(spark, sf):
    d = _docs(spark, sf).withColumn("content_hash", F.md5("text"))
    old = d.where("lang = 'en'").groupBy("content_hash").agg(F.min("doc_id").alias("seq"))
    new = d.where("lang <> 'en'").select("content_hash", F.col("doc_id").alias("seq"))
    return I.seen_after(old, new)


@query("SELECT min(doc_id) AS seq FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en') GROUP BY text")
def upsert_ignore(spark, sf):
    """Rows a second load would add to a store that holds the English documents."""
    d = hashed_rows(_docs(spark, sf).withColumnRenamed("doc_id", "seq"), ["text"])
    return new_rows(d.select("content_hash", "data", "seq"), d.where("lang = 'en'")).select("seq")


@query("SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY 1 DESC LIMIT 50")
def fetch_recent(spark, sf):
    return recent_rows(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"))


@query("SELECT 'https://x.example.com/' AS source_url, count(*) AS \"count\", least(count(*), 100) AS n_items, min(event_id) AS first_id FROM events")
def notify_payload(spark, sf):
    p = payload(_events(spark, sf).select(F.col("event_id").alias("seq"), F.col("event_id").alias("id"), "value"), "https://x.example.com/")
    return p.select("source_url", "count", F.size("items").alias("n_items"), F.get("items", F.lit(0))["id"].alias("first_id"))


@query("SELECT 'app.example.com_u_' || user_id || '_' || event_type AS slug, count(*) AS n FROM events GROUP BY 1")
def rows_by_url_slug(spark, sf):
    c = events_as_captures(_events(spark, sf))
    return c.groupBy(url_slug("url").alias("slug")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE nullif(lang, 'en') IS NOT NULL OR (CASE WHEN n_chars < 500 THEN '' ELSE source END) <> ''")
def drop_empty_rows(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.nullif("lang", F.lit("en")).alias("a"), F.when(F.col("n_chars") < 500, "").otherwise(F.col("source")).alias("b"), F.array().cast("array<string>").alias("c"))
    return I.drop_empty_rows(d, ["a", "b", "c"]).select("doc_id")


@query(
    """SELECT event_id, limit_used, limit_source FROM (SELECT e.event_id, l.lim AS limit_used, l.src AS limit_source, row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS rn
    FROM events e JOIN (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 5 WHEN user_id % 3 = 0 THEN 20 ELSE 30 END AS lim, CASE WHEN user_id % 2 = 0 THEN 'run_limit' WHEN user_id % 3 = 0 THEN 'max_files' ELSE 'default' END AS src
    FROM (SELECT DISTINCT user_id FROM events)) l USING (user_id)) WHERE rn <= limit_used"""
)
def limit_per_run(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("run_id"), "event_id")
    limits = e.select("run_id").distinct().select(
        "run_id", F.when(F.col("run_id") % 2 == 0, 5).alias("run_limit"), F.when(F.col("run_id") % 3 == 0, 20).alias("max_files"), F.lit(0).alias("max_items")
    )
    return I.limit_per_run(e, limits, 30, ["event_id"]).select("event_id", "limit_used", "limit_source")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 200")
def latest_n(spark, sf):
    return I.latest_n(_events(spark, sf), 200, ["ts", "event_id"], ["user_id"]).select("event_id")


@query(
    """WITH s AS (SELECT user_id AS page_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, floor(value * 10)::INTEGER AS h, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events),
    g AS (SELECT *, r >= 1 AND (h - lag(h) OVER w > 40 OR n - lag(n) OVER w > 3) AS grew, h - lag(h) OVER w AS step FROM s WHERE r <= 8 WINDOW w AS (PARTITION BY page_id ORDER BY r)),
    f AS (SELECT *, r >= 2 AND NOT grew AND NOT lag(grew) OVER (PARTITION BY page_id ORDER BY r) AS settled FROM g),
    a AS (SELECT page_id, min(CASE WHEN settled THEN r END) AS sr, max(r) AS er, min(CASE WHEN grew THEN r END) AS fr FROM f GROUP BY 1)
    SELECT a.page_id, coalesce(sr, er) AS rounds, CASE WHEN sr IS NOT NULL THEN 'settled' WHEN er >= 3 AND x.step > 40 THEN 'infinite' ELSE 'max_rounds' END AS reason, coalesce(fr <= coalesce(sr, er), FALSE) AS grew,
      greatest(0, x.h - b.h) AS height_gain, greatest(0, x.n - b.n) AS node_gain
    FROM a JOIN f x ON x.page_id = a.page_id AND x.r = coalesce(sr, er) JOIN f b ON b.page_id = a.page_id AND b.r = 0"""
)
def growth_stop(spark, sf):
    e = sequence_number(_events(spark, sf), ["user_id"], ["event_id"])
    s = e.select(
        F.col("user_id").alias("page_id"), (F.col("rn") - 1).cast("int").alias("round"), F.floor(F.col("value") * 10).cast("int").alias("height"),
        F.get_json_object("props", "$.k").try_cast("int").alias("nodes"),
    )
    return I.growth_stop(s)


@query(
    """SELECT doc_id, CASE WHEN rn = 1 THEN stem || '.mp3' ELSE stem || ' (' || rn || ').mp3' END AS new_name FROM
    (SELECT doc_id, 'f' || doc_id || '.mp3' AS filename, 'The ' || lang || ' - ' || source AS stem, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents)"""
)
def unique_names(spark, sf):
    d = _docs(spark, sf).select(
        "doc_id", F.lit("music").alias("folder"), F.concat(F.lit("The "), "lang").alias("artist"), F.col("source").alias("title"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".mp3")).alias("filename")
    )
    return I.unique_names(d, ["doc_id"]).select("doc_id", "new_name")


@query(
    """WITH i AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS v, min(o_orderkey) AS s FROM orders GROUP BY 1)
    SELECT coalesce(c_custkey, k) AS k, coalesce(v, c_acctbal) AS v, coalesce(c_custkey, s + 1 + (SELECT max(c_custkey) FROM customer)) AS seq FROM customer FULL JOIN i ON c_custkey = k"""
)
def upsert_latest(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("seq"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"))
    return I.upsert_latest(base, new, ["k"])


@query(
    """SELECT event_id::VARCHAR AS id, gap, coalesce(gap < 60, FALSE) AS too_soon FROM (SELECT event_id,
    (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id))) / 1e6 AS gap FROM events)"""
)
def access_gaps(spark, sf):
    """Seconds between logged accesses of one host; fifty hosts share the users of the log."""
    url = F.concat(F.lit("https://h"), (F.col("user_id") % 50).cast("string"), F.lit(".example.com/x"))
    log = _events(spark, sf).select("event_id", "ts", url.alias("url"))
    return I.access_gaps(log, ("ts", "event_id"), 60).select(F.col("event_id").cast("string").alias("id"), "gap", "too_soon")


@query(
    """SELECT 'h' || h || '.example.com' AS host, count(*) AS accesses, min(gap) AS shortest, round(avg(gap), 4) AS mean, count(CASE WHEN gap < 60 THEN 1 END) AS too_soon
    FROM (SELECT user_id % 50 AS h, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id))) / 1e6 AS gap FROM events) GROUP BY h"""
)
def host_pace(spark, sf):
    url = F.concat(F.lit("https://h"), (F.col("user_id") % 50).cast("string"), F.lit(".example.com/x"))
    log = _events(spark, sf).select("event_id", "ts", url.alias("url"))
    return I.host_pace(log, ("ts", "event_id"), 60).withColumn("mean", F.round("mean", 4))


@query("SELECT 'k' AS \"column\", 0 AS first_pos UNION ALL SELECT DISTINCT event_type, 1 FROM events")
def infer_columns(spark, sf):
    d = _events(spark, sf).select(F.col("event_id").alias("seq"), F.create_map(F.lit("k"), F.col("props"), "event_type", F.col("value").cast("string")).alias("data"))
    return I.infer_columns(d).select("column", "first_pos")


@query("SELECT doc_id, 3 AS n_keys, lang AS kept FROM documents")
def add_map_fields(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("data"))
    d = I.add_map_fields(d, {"lang": "xx", "batch": "b1"})
    return d.select("doc_id", F.size("data").alias("n_keys"), F.element_at("data", "lang").alias("kept"))


@query(
    "SELECT 'a' AS field, count(nullif(lang, 'en')) AS filled, count(*) AS total FROM documents UNION ALL SELECT 'b', count(CASE WHEN n_chars >= 500 THEN 1 END), count(*) FROM documents"
)
def field_coverage(spark, sf):
    d = _docs(spark, sf).select(F.nullif("lang", F.lit("en")).alias("a"), F.when(F.col("n_chars") < 500, "").otherwise(F.col("source")).alias("b"))
    return I.field_coverage(d, ["a", "b"])


@query(" UNION ALL ".join(f"SELECT '{f}' AS fmt, lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 2" for f in ("csv", "json", "jsonl", "parquet")))
def write_items(spark, sf):
    """Items written in each format and read back."""
    items = _docs(spark, sf).select("doc_id", "lang", "n_chars")
    back = []
    for fmt in ("csv", "json", "jsonl", "parquet"):
        path = f"{shared_folder(spark)}/items-{fmt}-{uuid.uuid4().hex}"
        write(items, path, fmt)
        if fmt == "csv":
            d = spark.read.option("header", "true").csv(path)
        elif fmt == "json":
            lines = spark.read.text(path).select(F.regexp_replace("value", r"^[\[,]\s*|\]$", "").alias("v")).where("v <> ''")
            d = lines.select(F.from_json("v", "doc_id bigint, lang string, n_chars bigint").alias("r")).select("r.*")
        else:
            d = spark.read.json(path) if fmt == "jsonl" else spark.read.parquet(path)
        back.append(d.select(F.lit(fmt).alias("fmt"), "lang", F.col("n_chars").cast("bigint").alias("n_chars")))
    return reduce(DataFrame.union, back).groupBy("fmt", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


# ---- captures ------------------------------------------------------------------


@query(
    """SELECT CASE WHEN event_type = 'view' THEN 'document' ELSE 'xhr' END AS resource_type, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, count(*) AS n,
    count(DISTINCT user_id) AS n_pages FROM events GROUP BY 1, 2"""
)
def captures_from_log(spark, sf):
    """The capture log written as JSON lines and read with the fixed schema."""
    path = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    events_as_captures(_events(spark, sf)).drop("event_type", "user_id", "value", "ts").write.json(path)
    log = read_captures(spark, path).where("_corrupt_record IS NULL")
    return log.groupBy("resource_type", "status").agg(F.count("*").alias("n"), F.countDistinct("page_url").alias("n_pages"))


@query("SELECT event_type, count(*) AS n, count(*) AS with_json FROM events GROUP BY 1")
def parse_body(spark, sf):
    return _captures(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.count("body_json").alias("with_json"))


@query("SELECT event_id::VARCHAR AS id, user_id FROM events WHERE event_type = 'purchase'")
def filter_captures(spark, sf):
    return C.filter_captures(_captures(spark, sf), r"/u/\d+/purchase$", "PURCHASE", 200, True, "xhr").select("id", "user_id")


@query("SELECT event_id::VARCHAR AS id FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id::VARCHAR DESC LIMIT 100")
def filter_by_bad_regex(spark, sf):
    """``/VIEW`` with an open bracket is no regex, so it is searched as text, ignoring case."""
    c = _captures(spark, sf).withColumn("url", F.regexp_replace("url", "view$", "view("))
    return C.filter_captures(c, "/VIEW(", limit=100).select("id")


@query("SELECT 'xhr' AS resource_type, count(*) AS n FROM events WHERE event_type <> 'view'")
def capturable(spark, sf):
    return C.capturable(_captures(spark, sf)).groupBy("resource_type").agg(F.count("*").alias("n"))


_MIME = "CASE WHEN event_type = 'signup' THEN 'unknown' ELSE 'application/' || event_type || '+json' END"


@query(
    f"SELECT {_MIME} AS mime, count(*) AS n, (SELECT count(*) FROM events) AS total, (SELECT count(*) FROM events) AS with_json, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed, 0 AS websockets FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"
)
def capture_stats(spark, sf):
    s = C.capture_stats(_captures(spark, sf))
    return s.select(F.explode("by_mime").alias("mime", "n"), "total", "with_json", "failed", "websockets")


@query(
    "SELECT user_id, id, body_text FROM (SELECT user_id, event_id::VARCHAR AS id, props AS body_text, row_number() OVER (PARTITION BY user_id ORDER BY length(props) DESC, event_id::VARCHAR DESC) AS rn FROM events) WHERE rn = 1"
)
def largest_json(spark, sf):
    return C.largest_json(_captures(spark, sf), ["user_id"]).select("user_id", "id", "body_text")


@query(
    """SELECT event_id::VARCHAR AS id, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'GET' END AS method, CASE WHEN event_type IN ('click', 'purchase') THEN 200 END AS status,
    CASE WHEN event_type IN ('click', 'view', 'error') AND event_type <> 'view' THEN round(value * 1000, 2) END AS duration_ms FROM events"""
)
def correlate(spark, sf):
    e = _events(spark, sf).withColumn("id", F.col("event_id").cast("string"))
    req = e.where("event_type in ('click', 'view', 'error')").select("id", F.lit("GET").alias("method"), F.lit(100.0).alias("timestamp"))
    res = e.where("event_type in ('click', 'purchase')").select("id", F.lit(200).alias("status"))
    end = e.where("event_type <> 'view'").select("id", (F.lit(100.0) + F.col("value")).alias("end_ts"))
    return C.correlate(req, res, end).select("id", "method", "status", "duration_ms")


@query("SELECT event_id::VARCHAR AS id, 'json' AS mode, '$.data.list[*]' AS item_selector, 2 AS n_fields, 'float' AS first_step, 'strip' AS second_step FROM events")
def guess_json_rule(spark, sf):
    c = _captures(spark, sf)
    body = F.concat(F.lit('{"code": 0, "data": {"total": 1, "list": [{"id": '), "id", F.lit(', "kind": "'), "event_type", F.lit('"}]}}'))
    g = C.guess_json_rule(c.withColumn("body_json", body))
    return g.select("id", "mode", "item_selector", F.size("fields").alias("n_fields"), F.get("fields", F.lit(0))["transform"][0].alias("first_step"), F.get("fields", F.lit(1))["transform"][0].alias("second_step"))


@query("SELECT event_id::VARCHAR AS id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def extract_json(spark, sf):
    rule = Rule("$", (Field("k", "$.k", None, ("int",), True), Field("k_text", "k"), ), mode="json")
    return finish_rows(items_of_json(_captures(spark, sf), rule), rule, "page_url").select("id", "k", "k_text")


@query(
    """WITH c AS (SELECT 'https://app.example.com/u/' || user_id AS page_url, event_id::VARCHAR AS id, 'https://cdn.example.com/' || user_id || '/' || event_id || '.mp3' AS url FROM events),
    i AS (SELECT page_url, id, url, 82 AS score FROM c UNION ALL SELECT page_url, id, 'https://proxy.example.com/get?file=' || replace(replace(url, ':', '%3A'), '/', '%2F'), 82 FROM c)
    SELECT page_url, url, score FROM i"""
)
def sniff_media_urls(spark, sf):
    """Responses made from the events: a media link wrapped in a proxy link, a cover picture, a client download."""
    c = _captures(spark, sf)
    link = F.concat(F.lit("https://cdn.example.com/"), F.col("user_id").cast("string"), F.lit("/"), "id", F.lit(".mp3"))
    body = F.concat(
        F.lit('{"data": {"playUrl": "https://proxy.example.com/get?file='), F.url_encode(link),
        F.lit('", "pic": "https://cdn.example.com/cover.jpg", "client": {"url": "https://pkg.example.com/setup.exe"}}}'),
    )
    return M.sniff_media_urls(c.withColumn("body_json", body)).select("page_url", "url", "score")


@query(
    f"SELECT date_trunc('hour', ts) AS window_start, {_MIME} AS mime, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1, 2"
)
def stats_by_hour(spark, sf):
    c = _captures(spark, sf)
    return stats_by_window(c, "ts", "1 hour").select("window_start", "mime", "total", "failed")


@query("SELECT event_id, 0 AS pos, json_extract_string(props, '$.k') AS value FROM events")
def jsonpath_rows(spark, sf):
    register_jsonpath_rows(spark)
    _events(spark, sf).select("event_id", "props").createOrReplaceTempView("webframe_events")
    return spark.sql("SELECT event_id, pos, value FROM webframe_events, LATERAL jsonpath_rows(props, '$..k')")


@query("SELECT event_id, 'x' AS batch, value * 2 AS doubled FROM events WHERE event_type <> 'error'")
def user_steps(spark, sf):
    steps = [
        Step("drop", lambda d, c: d.where(F.col("event_type") != c["kind"]), {"kind": "error"}),
        Step("broken", lambda d, c: d.select("no_such_column")),
        Step("add", lambda d, c: I.add_fields(d, c), {"batch": "x"}),
        Step("double", lambda d, c: d.withColumn("doubled", F.col("value") * 2)),
        Step("unused", lambda d, c: d.limit(0)),
    ]
    done = run_steps(_events(spark, sf), steps, only=["drop", "broken", "add", "double"])
    return done.df.select("event_id", "batch", "doubled")


# ---- runs and files ------------------------------------------------------------


def _runs(spark, sf):
    e = _events(spark, sf)
    url = F.when(F.col("event_type") == "signup", "").otherwise(F.concat(F.lit("https://site"), (F.col("user_id") % 7).cast("string"), F.lit(".example.com/a")))
    return e.select(
        F.col("event_id").alias("run_id"), url.alias("url"), F.col("event_type").alias("kind"), F.floor("value").cast("bigint").alias("item_count"), F.col("ts").alias("created_at")
    )


def _files(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("bytes"))


_GROUP = "CASE WHEN event_type = 'signup' THEN '(no url)::signup' ELSE 'https://site' || (user_id % 7) || '.example.com/a' END"


@query(
    f"""WITH f AS (SELECT l_orderkey AS run_id, count(*) AS n, sum(l_partkey) AS b FROM lineitem GROUP BY 1)
    SELECT {_GROUP} AS group_key, count(*) AS run_count, sum(floor(value)::BIGINT) AS item_count, coalesce(sum(n), 0) AS file_count, coalesce(sum(b), 0) AS bytes, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds,
      CASE WHEN event_type = 'signup' THEN '' ELSE 'site' || (min(user_id) % 7) || '.example.com' END AS host FROM events LEFT JOIN f ON f.run_id = event_id GROUP BY {_GROUP}, event_type = 'signup', CASE WHEN event_type = 'signup' THEN 'signup' ELSE '' END, (CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END)"""
)
def url_groups(spark, sf):
    g = N.url_groups(_runs(spark, sf), _files(spark, sf))
    return g.select("group_key", "run_count", "item_count", "file_count", "bytes", F.array_join("kinds", ",").alias("kinds"), "host")


@query(
    f"""WITH f AS (SELECT l_orderkey AS run_id, count(*) AS n, sum(l_partkey) AS b FROM lineitem GROUP BY 1)
    SELECT event_id AS run_id, {_GROUP} AS group_key, coalesce(n, 0) AS file_count, coalesce(b, 0) AS bytes, row_number() OVER (PARTITION BY {_GROUP} ORDER BY ts DESC, event_id) AS position FROM events LEFT JOIN f ON f.run_id = event_id"""
)
def url_group_runs(spark, sf):
    return N.url_group_runs(_runs(spark, sf), _files(spark, sf)).select("run_id", "group_key", "file_count", "bytes", "position")


@query("SELECT user_id || '/' || event_type AS url, arg_max(value, event_id) AS value, max(event_id) AS attempt FROM events GROUP BY 1")
def retry_merge(spark, sf):
    e = _events(spark, sf).select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("url"), F.col("event_id").alias("attempt"), "value")
    return N.retry_merge(e)


@query("SELECT e.event_id, c.c_name AS title FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def with_item_metadata(spark, sf):
    files = _events(spark, sf).select("event_id", F.col("user_id").alias("source_item_index"))
    items = table(spark, sf, "customer").select(F.col("c_custkey").alias("item_index"), F.col("c_name").alias("title"))
    return N.with_item_metadata(files, items).select("event_id", "title")


@query(
    """SELECT doc_id AS file_id, ok = FALSE OR rn = 1 AS keep FROM (SELECT doc_id, lang <> 'es' AS ok, row_number() OVER (PARTITION BY source, lang <> 'es' ORDER BY n_chars DESC, doc_id) AS rn FROM documents)"""
)
def keep_largest_by_stem(spark, sf):
    d = _docs(spark, sf).select(
        F.col("doc_id").alias("file_id"), F.concat("source", F.lit("_"), F.substring(F.md5("text"), 1, 10), F.lit(".mp3")).alias("filename"), F.col("n_chars").alias("size"), (F.col("lang") != "es").alias("ok")
    )
    return N.keep_largest_by_stem(d).select("file_id", "keep")


@query(
    "SELECT user_id AS run_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, arg_min('e' || event_id, event_id) FILTER (event_type = 'error') AS first_error, count(*) FILTER (event_type <> 'error') = 0 AS all_failed FROM events GROUP BY 1"
)
def download_summary(spark, sf):
    e = _events(spark, sf)
    bad = F.col("event_type") == "error"
    d = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("file_id"), (~bad).alias("ok"), F.when(bad, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"))
    return N.download_summary(d)


@query(
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.5 END AS progress, CASE WHEN event_type IN ('error', 'view') OR floor(value) = 0 THEN 'failed' ELSE 'success' END AS status,
    CASE WHEN NOT (event_type IN ('error', 'view') OR floor(value) = 0) THEN (CASE WHEN event_type = 'signup' THEN 'done_with_missing_files' ELSE 'done' END)
         WHEN event_type = 'error' THEN 'robots_denied' WHEN floor(value) = 0 THEN 'no_items' ELSE 'partial' END AS outcome FROM events"""
)
def run_status(spark, sf):
    kind = F.col("event_type")
    step = lambda s: F.struct(F.lit("x").alias("key"), s.alias("status"))
    none = F.array().cast("array<string>")
    e = _events(spark, sf).select(
        "event_id", F.floor("value").cast("int").alias("item_count"), F.when(kind == "signup", 2).otherwise(0).alias("failed_files"),
        F.array(step(F.lit("done")), step(F.when(kind == "purchase", "skipped").otherwise("running"))).alias("steps"),
        F.when(kind == "error", F.array(F.lit("denied by robots"))).when(kind == "view", F.array(F.lit("boom"), F.lit("download failed"))).when(kind == "signup", F.array(F.lit("download failed"))).otherwise(none).alias("errors"),
    )
    return N.run_status(e).select("event_id", "progress", "status", "outcome")
