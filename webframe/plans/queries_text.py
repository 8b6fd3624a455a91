"""Queries on documents and conversations: cleaning, diagnosis, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from webframe.functions import text as T
from webframe.functions import urls as U
from webframe.functions.jsonpath import flatten_json, jsonpath
from webframe.operators import diagnose as A
from webframe.operators import structure as D
from webframe.operators.extract import apply_transforms, finish_rows, validate_items as split_valid
from webframe.operators.rules import Field, Rule
from webframe.plans.catalog import query, table

_NUMBER = "regexp_extract(replace(text, ',', ''), '{}')"


@query(
    f"""SELECT doc_id, try_cast({_NUMBER.format('-?[0-9]+')} AS BIGINT) AS as_int, try_cast({_NUMBER.format('-?[0-9]+([.][0-9]+)?')} AS DOUBLE) AS as_float,
    try_cast(regexp_extract(regexp_replace(text, '[,，]', '', 'g'), '[0-9]+([.][0-9]+)?') AS DOUBLE) AS as_price,
    md5(upper(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 'ß', 'SS'))) AS as_upper, md5(lower(text)) AS as_lower,
    CASE WHEN regexp_matches(source, '[a-z]+([0-9]+)') THEN regexp_extract(source, '[a-z]+([0-9]+)', 1) ELSE source END AS as_regex FROM documents"""
)
def clean_text(spark, sf):
    t = lambda c, *steps: apply_transforms(c, steps)
    return table(spark, sf, "documents").select(
        "doc_id", t("text", "int").alias("as_int"), t("text", "strip", "float").alias("as_float"), t("text", "price").alias("as_price"),
        F.md5(t("text", "strip", "upper")).alias("as_upper"), F.md5(t("text", "lower")).alias("as_lower"),
        t("source", "regex:[a-z]+([0-9]+)").alias("as_regex"),
    )


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d1, strftime(o_orderdate, '%Y-%m-%d') AS d2, strftime(o_orderdate, '%Y-%m-%d') AS d3, "
    "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS d4, strftime(o_orderdate, '%Y-%m-%d') AS d5, o_orderpriority AS d6 FROM orders"
)
def clean_dates(spark, sf):
    d = lambda fmt: T.to_date_text(F.date_format("o_orderdate", fmt))
    return table(spark, sf, "orders").select(
        "o_orderkey", d("yyyy/M/d").alias("d1"), d("yyyy年M月d日").alias("d2"), d("M/d/yyyy").alias("d3"),
        d("yyyy-MM-dd'T'HH:mm:ss").alias("d4"), d("yyyy-MM-dd HH:mm:ss").alias("d5"), T.to_date_text("o_orderpriority").alias("d6"),
    )


@query(
    "SELECT doc_id, try_cast(regexp_extract(regexp_replace(text, '[,，]', '', 'g'), '[0-9]+([.][0-9]+)?') AS DOUBLE) AS price, source AS link FROM documents "
    "WHERE regexp_matches(text, '[0-9]')"
)
def finish_required(spark, sf):
    rule = Rule("", (Field("price", "x", None, ("strip", "price"), True), Field("link", "y", None, ("strip",))))
    raw = table(spark, sf, "documents").select("doc_id", F.col("text").alias("price"), F.col("source").alias("link"))
    return finish_rows(raw, rule)


@query(
    """SELECT status, count(*) AS n, sum(seq) AS seq_sum FROM (SELECT CASE WHEN try_cast(l_partkey AS SMALLINT) IS NULL OR try_cast(l_orderkey AS TINYINT) IS NULL THEN 'error' ELSE 'valid' END AS status,
    l_orderkey * 10 + l_linenumber AS seq FROM lineitem) GROUP BY 1"""
)
def validate_items(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_partkey", "l_orderkey")
    valid, errors = split_valid(rows, {"l_partkey": "smallint", "l_orderkey": "tinyint"})
    both = valid.select("seq", F.lit("valid").alias("status")).unionByName(errors.select("seq", F.lit("error").alias("status")))
    return both.groupBy("status").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum"))


@query(
    """SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda c: NOT regexp_matches(c, '^(css-|sc-|chakra-|jsx-|svelte-)') AND NOT regexp_matches(c, '(?i)[a-f0-9]{10,}') AND length(c) <= 40)) AS stable,
    len(regexp_split_to_array(text, '\\s+')) AS words FROM documents"""
)
def stable_classes(spark, sf):
    words = F.split("text", r"\s+")
    return table(spark, sf, "documents").select("doc_id", F.size(D.stable_classes(words)).alias("stable"), F.size(words).alias("words"))


_GENERATED = (
    "regexp_matches(w, '(?i)^[a-z]{1,3}-?[a-z]{0,4}[0-9]{1,3}$') OR regexp_matches(w, '(?i)^(css|sc|jsx|emotion|styled)-') OR (length(w) >= 6 AND regexp_matches(w, '^[a-z]+[A-Z]'))"
)


@query(
    f"""SELECT w, (w NOT IN ('title', 'link', 'image', 'audio', 'video', 'price', 'thumb', 'image_srcset', 'text')) AND ({_GENERATED}) AS by_discovery,
    w <> '' AND regexp_matches(translate(trim(w), '_', '-'), '^(?:[a-z]{{1,3}}-?[a-z]{{0,4}}[0-9]{{1,3}}|(?:css|sc|jsx|emotion|styled)-.*|[a-z]{{2,}}[A-Z][a-zA-Z]{{2,}}|td|th|tr|span|div|li|em|b|i|p)$') AS by_rule
    FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM conversations UNION SELECT source FROM documents)"""
)
def generated_names(spark, sf):
    words = table(spark, sf, "conversations").select(F.explode(F.split("text", r"\s+")).alias("w"))
    words = words.unionByName(table(spark, sf, "documents").select(F.col("source").alias("w"))).distinct()
    return words.select("w", D.looks_generated("w").alias("by_discovery"), D.looks_generated_name("w").alias("by_rule"))


def _semantic_sql() -> str:
    cases = []
    for pattern, name in D.SEMANTIC_RULES:
        hit = f"regexp_matches(p, '(?i){pattern}')"
        if name == "duration":
            hit += " OR regexp_matches(trim(text), '^\\d{1,2}:\\d{2}(:\\d{2})?$')"
        cases.append(f"WHEN {hit} THEN '{name}'")
    return f"SELECT doc_id, CASE {' '.join(cases)} ELSE 'text' END AS name FROM (SELECT doc_id, text, lower(concat_ws(' ', source, text, lang)) AS p FROM documents)"


@query(_semantic_sql())
def semantic_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", D.semantic_name("source", "text", "lang", F.lit("text")).alias("name"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(n, 'link|href|url') THEN 'link' WHEN regexp_matches(n, 'price|价|amount') THEN 'price' WHEN regexp_matches(n, 'title|name|标题|名称|text') THEN 'title'
    WHEN regexp_matches(n, 'img|image|pic|图') THEN 'image' WHEN n = '' THEN 'field' ELSE regexp_replace(n, '[^\\p{L}\\p{N}_]', '_', 'g') END AS name
    FROM (SELECT doc_id, lower(trim(source || '-' || lang)) AS n FROM documents)"""
)
def normalize_field_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", D.normalize_field_name(F.concat_ws("-", "source", "lang"), F.lit(None).cast("string")).alias("name"))


def _keyword_case(label: str, pattern: str, weight: float) -> str:
    return f"CASE WHEN regexp_matches(h, '(?i){pattern}') THEN {weight} ELSE 0 END"


def _issue_sql() -> str:
    kinds: list[str] = []
    for _, _, kind, _ in A.KEYWORDS:
        if kind not in kinds:
            kinds.append(kind)
    sums, firsts = [], []
    for kind in kinds:
        own = [(i, p, w) for i, (p, _, k, w) in enumerate(A.KEYWORDS) if k == kind]
        sums.append(" + ".join(_keyword_case("", p, w) for _, p, w in own) + f" AS s_{kind}")
        firsts.append("least(" + ", ".join(f"CASE WHEN regexp_matches(h, '(?i){p}') THEN {i} ELSE 999 END" for i, p, _ in own) + f", 999) AS f_{kind}")
    hits = " + ".join(f"CASE WHEN regexp_matches(h, '(?i){p}') THEN 1 ELSE 0 END" for p, _, _, _ in A.KEYWORDS)
    shell = "CASE WHEN length(regexp_replace(text, '\\s+', '', 'g')) < 80 THEN 0.5 ELSE 0 END AS s_spa_shell, 500 AS f_spa_shell"
    allk = kinds + ["spa_shell"]
    top = "greatest(" + ", ".join(f"s_{k}" for k in allk) + ")"
    order = ", ".join(f"CASE WHEN s_{k} = {top} AND s_{k} > 0 THEN {{'o': f_{k}, 'k': '{k}'}} END" for k in allk)
    return (
        f"SELECT doc_id, coalesce(list_sort(list_filter([{order}], lambda x: x IS NOT NULL))[1].k, 'empty_page') AS issue_type, "
        f"round(least({top}, 1.0), 2)::DOUBLE AS confidence, least({top}, 1.0) >= 0.5 AS detected, n_hits FROM "
        f"(SELECT doc_id, {', '.join(sums)}, {', '.join(firsts)}, {hits} AS n_hits, {shell} FROM (SELECT doc_id, text, source || chr(10) || text AS h FROM documents))"
    )


@query(_issue_sql())
def access_issue(spark, sf):
    """Documents read as the visible text of pages without links or forms."""
    none = lambda kind: F.array().cast(kind)
    pt = table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.col("text").alias("body_text"), F.lit(None).cast("string").alias("main_text"),
        none("array<struct<selector:string,action:string,method:string,has_password:boolean,inputs:array<string>>>").alias("forms"),
        F.lit(0).alias("password_inputs"), none("array<string>").alias("captcha"), none("array<string>").alias("auth_links"),
        F.lit(0).alias("interactive_count"), F.lit(40).alias("dom_nodes"),
    )
    d = A.access_issue(pt)
    return d.select(F.col("page_id").alias("doc_id"), "issue_type", "confidence", "detected", F.size("keyword_hits").alias("n_hits"))


@query(
    """WITH b AS (SELECT doc_id, text, length(regexp_replace(text, '\\s+', '', 'g')) < 80 AS short, text ILIKE '%not found%' AS nf, regexp_matches(text, '(?i)(?:access|request)?\\s*blocked') AS bl FROM documents)
    SELECT b.doc_id, CASE WHEN bl AND q.quality IS DISTINCT FROM 1 THEN FALSE WHEN nf AND NOT short AND q.quality IS DISTINCT FROM 1 THEN FALSE ELSE TRUE END AS "extract" FROM b LEFT JOIN labels q USING (doc_id)"""
)
def gate_blocked(spark, sf):
    """Skip documents that speak of a block or a missing page, unless labelled as good content."""
    docs = table(spark, sf, "documents")
    hits = A.keyword_hits("text")
    pages = docs.select(F.col("doc_id").alias("page_id"))
    shell = F.length(F.regexp_replace("text", r"\s+", "")) < 80
    kinds = docs.select(F.col("doc_id").alias("page_id"), shell.alias("shell"), F.transform(hits, lambda h: h["kind"]).alias("k"))
    kind = F.when(F.array_contains("k", "risk_control"), "risk_control").when(F.array_contains("k", "not_found") & ~F.col("shell"), "not_found").otherwise("spa_shell")
    issues = kinds.select("page_id", (F.size("k") > 0).alias("detected"), kind.alias("issue_type"))
    content = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("has_content"))
    return A.gate_blocked(pages, issues, content).select(F.col("page_id").alias("doc_id"), "extract")


def _block_sql() -> str:
    hits = " + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN 1 ELSE 0 END" for p, _ in A.BLOCK_PATTERNS)
    return f"SELECT doc_id, {hits} AS n_hits FROM (SELECT doc_id, lower(text) AS t FROM documents)"


@query(_block_sql())
def block_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(A.block_hits("text")).alias("n_hits"))


_SIGNALS = {
    "login_prompt": "c_acctbal < 0", "login_links": "c_nationkey < 10", "password_input": "c_mktsegment = 'BUILDING'", "auth_form": "c_mktsegment = 'MACHINERY'",
    "logout": "c_acctbal > 8000", "avatar": "c_nationkey = 3", "own_nav": "c_nationkey > 20", "account_prompt": "c_mktsegment = 'FURNITURE'", "account_path": "c_acctbal > 9000",
}


@query(
    """WITH w AS (SELECT c_custkey, (CASE WHEN c_acctbal < 0 THEN 0.45 ELSE 0 END + CASE WHEN c_nationkey < 10 THEN 0.25 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 0.30 ELSE 0 END + CASE WHEN c_mktsegment = 'MACHINERY' THEN 0.25 ELSE 0 END)::DECIMAL(9,4) AS a0,
      (CASE WHEN c_acctbal > 8000 THEN 0.55 ELSE 0 END + CASE WHEN c_nationkey = 3 THEN 0.30 ELSE 0 END + CASE WHEN c_nationkey > 20 THEN 0.30 ELSE 0 END + CASE WHEN c_mktsegment = 'FURNITURE' THEN 0.25 ELSE 0 END + CASE WHEN c_acctbal > 9000 THEN 0.35 ELSE 0 END)::DECIMAL(9,4) AS u, c_mktsegment AS m FROM customer),
    x AS (SELECT c_custkey, u, (a0 + CASE WHEN u = 0 AND a0 > 0 THEN 0.15 ELSE 0 END + CASE WHEN u = 0 AND m = 'MACHINERY' THEN 0.35 ELSE 0 END)::DECIMAL(9,4) AS a FROM w),
    y AS (SELECT *, CASE WHEN u >= 0.4 AND u - a > 0.05 THEN 'logged_in' WHEN a >= 0.4 AND u - a < -0.05 THEN 'anonymous' ELSE 'unknown' END AS state FROM x)
    SELECT c_custkey, state, round(least(CASE state WHEN 'logged_in' THEN u WHEN 'anonymous' THEN a ELSE greatest(a, u) END, 1.0), 2)::DOUBLE AS confidence FROM y"""
)
def login_state(spark, sf):
    s = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("page_id"), *[F.expr(e).alias(k) for k, e in _SIGNALS.items()],
        F.when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(0).alias("auth_form_count"),
    )
    return A.login_state(s).select(F.col("page_id").alias("c_custkey"), "state", "confidence")


@query(
    """SELECT c_custkey, (c_acctbal < 0 OR c_nationkey < 5) AND s >= 0.5 AS challenged, s::DOUBLE AS confidence, CASE WHEN c_mktsegment = 'BUILDING' THEN 'hCaptcha' WHEN c_mktsegment = 'MACHINERY' THEN 'GeeTest' ELSE 'unknown' END AS vendor
    FROM (SELECT *, least(round((CASE WHEN c_acctbal < 0 THEN 0.7 ELSE 0 END) + (CASE WHEN c_nationkey < 5 THEN 0.5 ELSE 0 END) + (CASE WHEN c_acctbal > 5000 THEN 0.35 ELSE 0 END), 2), 1.0) AS s FROM customer)"""
)
def challenge(spark, sf):
    vendor = F.when(F.col("c_mktsegment") == "BUILDING", "https://js.hcaptcha.com/1").when(F.col("c_mktsegment") == "MACHINERY", "geetest_panel").otherwise("")
    s = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("page_id"), (F.col("c_acctbal") < 0).cast("int").alias("frames"), (F.col("c_nationkey") < 5).cast("int").alias("boxes"),
        (F.col("c_acctbal") > 5000).alias("text_hit"), vendor.alias("evidence"),
    )
    return A.challenge(s).withColumnRenamed("page_id", "c_custkey")


@query(
    """SELECT doc_id, length(t) AS n, md5(t) AS h FROM (SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE
    substr(text, 1, (200 - length(m)) // 2) || m || right(text, (200 - length(m)) - (200 - length(m)) // 2) END AS t
    FROM (SELECT doc_id, text, chr(10) || '...[中间省略 ' || (length(text) - 200) || ' 字符, 已保留头尾]...' || chr(10) AS m FROM documents))"""
)
def truncate_middle(spark, sf):
    t = T.truncate_middle("text", 200)
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.length("t").alias("n"), F.md5("t").alias("h"))


@query(
    "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS flat, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\u00a0]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS normal FROM documents"
)
def flatten_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.flatten_text("text", None)).alias("flat"), F.md5(T.norm_text("text")).alias("normal"))


@query(
    """SELECT doc_id, nullif(regexp_extract(t, '(?i)\\bcode\\b[\\s:：=]+(\\d{3,6})\\b', 1), '') AS code, nullif(regexp_extract(t, '\\b(\\d{13,})\\b', 1), '') AS long_number,
    nullif(regexp_extract(t, '(?i)\\b(request|trace|track|log)[_\\s-]?id\\b[\\s:=]+([A-Za-z0-9-]{6,64})', 2), '') AS request_id
    FROM (SELECT doc_id, text || ' code: ' || (n_chars + 1000) || ' request_id=' || substr(md5(text), 1, 8) AS t FROM documents)"""
)
def extract_codes(spark, sf):
    t = F.concat("text", F.lit(" code: "), (F.col("n_chars") + 1000).cast("string"), F.lit(" request_id="), F.substring(F.md5("text"), 1, 8))
    d = table(spark, sf, "documents").select("doc_id", T.extract_codes(t).alias("m"))
    g = lambda k: F.try_element_at("m", F.lit(k))
    return d.select("doc_id", g("code").alias("code"), g("timestamp_like").alias("long_number"), g("request_id").alias("request_id"))


@query("SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) < 80 AND (n_chars < 40 OR lang = 'en') AS shell FROM documents")
def spa_shell(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("lang") == "en", 0).otherwise(3).alias("i"), F.when(F.col("n_chars") < 40, 5).otherwise(30).alias("n"))
    return d.select("doc_id", T.looks_like_spa_shell("text", "i", "n").alias("shell"))


@query("SELECT doc_id, 1 + n_chars % 100 AS wanted FROM documents")
def parse_count(spark, sf):
    goal = F.concat("text", F.lit(" get the first "), (F.col("n_chars") % 100 + 1).cast("string"), F.lit(" items"))
    return table(spark, sf, "documents").select("doc_id", T.parse_count(goal).cast("bigint").alias("wanted"))


@query(
    """SELECT doc_id, CASE WHEN length(text) <= 8 THEN repeat('*', length(text)) ELSE substr(text, 1, 4) || '********' || right(text, 4) END AS masked,
    'http://***@' || lang || '.proxy:8080' AS proxy FROM documents"""
)
def mask_secret(spark, sf):
    proxy = F.concat(F.lit("http://"), "source", F.lit(":pw@"), "lang", F.lit(".proxy:8080"))
    return table(spark, sf, "documents").select("doc_id", T.mask_secret("text").alias("masked"), T.mask_proxy(proxy).alias("proxy"))


@query(
    """SELECT event_id, event_type = 'click' AS b, trunc(value)::BIGINT AS i, value AS f, len([event_type, user_id::VARCHAR]) AS l, props AS j FROM events"""
)
def coerce_values(spark, sf):
    word = F.when(F.col("event_type") == "click", " Yes ").otherwise("off")
    return table(spark, sf, "events").select(
        "event_id", T.coerce(word, "bool").alias("b"), T.coerce(F.col("value").cast("string"), "int").alias("i"), T.coerce(F.col("value").cast("string"), "float").alias("f"),
        F.size(T.coerce(F.concat("event_type", F.lit(", '"), F.col("user_id").cast("string"), F.lit("'\n")), "list")).alias("l"), T.coerce("props", "json").alias("j"),
    )


@query(
    """SELECT conv_id, turn, '{"n": ' || length(text) || ', "q": "a}b"}' AS block FROM conversations"""
)
def json_block(spark, sf):
    c = table(spark, sf, "conversations")
    t = F.concat("text", F.lit(' {"n": '), F.length("text").cast("string"), F.lit(', "q": "a}b"} and more'))
    return c.select("conv_id", "turn", T.json_block(t).alias("block"))


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'list[1]', user_id::VARCHAR FROM events UNION ALL SELECT event_id, 'list[0]', event_type FROM events")
def flatten_nested(spark, sf):
    e = table(spark, sf, "events")
    doc = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "list": ["'), "event_type", F.lit('", '), F.col("user_id").cast("string"), F.lit("]}"))
    return e.select("event_id", F.explode(flatten_json(doc)).alias("l")).select("event_id", "l.path", "l.value")


@query(
    """SELECT event_id, json_extract_string(props, '$.k') AS by_key, json_extract_string(props, '$.k') AS by_bare, 0 AS missing, event_type AS last_item, 2 AS n_all, user_id::VARCHAR AS deep FROM events"""
)
def jsonpath_values(spark, sf):
    e = table(spark, sf, "events")
    doc = F.concat(F.lit('{"a": [{"id": '), F.col("user_id").cast("string"), F.lit('}, "'), "event_type", F.lit('"]}'))
    one = lambda c, p: F.get(jsonpath(c, p), F.lit(0))
    return e.select(
        "event_id", one("props", "$.k").alias("by_key"), one("props", "k").alias("by_bare"), F.size(jsonpath("props", "$.none[0]")).alias("missing"),
        one(doc, "$.a[-1]").alias("last_item"), F.size(jsonpath(doc, "$.a[*]")).alias("n_all"), one(doc, "$..id").alias("deep"),
    )


@query(
    """SELECT doc_id, (doc_id + 10)::VARCHAR AS song, 2 AS pieces, regexp_matches(text, '(?i)timeout|timed out|超时|connect|connection|reset|refused|unreachable|Temporary failure|502|503|504|429|too many requests')
      AND NOT (regexp_matches(text, '\\b40[0-9]\\b') AND NOT regexp_matches(text, '\\b429\\b')) AS transient FROM documents"""
)
def song_ids(spark, sf):
    link = F.concat(F.lit("https://m.example.com/song?id="), (F.col("doc_id") + 10).cast("string"))
    return table(spark, sf, "documents").select(
        "doc_id", U.song_id(link).alias("song"), F.size(U.url_fragments(F.concat("source", F.lit(" "), link, F.lit("\n/x/y "), link))).alias("pieces"),
        U.is_transient_error("text").alias("transient"),
    )


@query("SELECT doc_id, md5(text) AS h, CASE lang WHEN 'en' THEN 1 ELSE 2 END AS k FROM documents")
def stable_hash(spark, sf):
    """Equal rows hash equal, whatever the column order; only the grouping is compared."""
    d = table(spark, sf, "documents")
    same = T.stable_hash("text", "lang") == T.stable_hash("lang", "text")
    as_map = T.stable_map_hash(F.create_map(F.lit("b"), "lang", F.lit("a"), "text")) == T.stable_map_hash(F.create_map(F.lit("a"), "text", F.lit("b"), "lang"))
    return d.where(same & as_map).select("doc_id", F.md5("text").alias("h"), F.when(F.col("lang") == "en", 1).otherwise(2).alias("k"))


@query(
    """SELECT event_id, md5('{"event_type":"' || event_type || '","props":' || to_json(props) || ',"user_id":' || user_id || '}') AS row_hash FROM events"""
)
def content_hash(spark, sf):
    """The hash itself: MD5 of the row as JSON with its names in order."""
    return table(spark, sf, "events").select("event_id", T.stable_hash("user_id", "props", "event_type").alias("row_hash"))
