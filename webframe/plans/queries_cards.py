"""Queries on pages that Spark writes from the order tables: one page per order, one card per line."""

from __future__ import annotations

from pyspark.sql import functions as F

from webframe.functions.media import sniff_kind
from webframe.operators import diagnose as A
from webframe.operators import media as M
from webframe.operators import report as R
from webframe.operators import rule_tables as RT
from webframe.operators import structure as D
from webframe.operators.extract import extract_dom, finish_rows, node_columns, node_tags
from webframe.operators.rules import Field, Rule, validate_rules
from webframe.plans.catalog import query, table
from webframe.plans.lineage import cut
from webframe.plans.queries_pages import _LI
from webframe.plans.steps import row_step
from webframe.sources.nodes import html_nodes
from webframe.sources.pages import read_pages


def _order_pages(spark, sf, card):
    """An order has at most seven lines, so a page is a bounded group."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", card.alias("html")).alias("c"))
    body = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("c")).alias("cards"))
    cards = F.array_join(F.transform("cards", lambda c: c["html"]), "")
    return body.select(
        F.col("l_orderkey").alias("page_id"), F.lit("http://shop.example.com/orders/").alias("url"),
        F.concat(F.lit("<body><div class='grid'>"), cards, F.lit("</div></body>")).alias("html"),
    )


def _text(c):
    return F.col(c).cast("string")


@query(
    """WITH g AS (SELECT l_orderkey AS page_id, l_returnflag AS f, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_orderkey) AS total FROM lineitem GROUP BY 1, 2),
    b AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS k, sum(n) OVER (PARTITION BY page_id) AS u FROM g WHERE n >= 3)
    SELECT page_id, 'div.grid > div.card.' || f AS item_selector, n AS "count" FROM b WHERE NOT (k > 1 AND u = total)
    UNION ALL SELECT DISTINCT page_id, 'div.grid > div', u FROM b WHERE k > 1 AND u = total"""
)
def merge_split_groups(spark, sf):
    card = F.concat(F.lit("<div class='card "), "l_returnflag", F.lit("'><b>Line number "), _text("l_linenumber"), F.lit("</b></div>"))
    nodes = cut(html_nodes(_order_pages(spark, sf, card), D.LIST_COLUMNS))
    return D.list_candidates(nodes, merge=True).select("page_id", "item_selector", "count")


@query(
    "SELECT l_orderkey AS page_id, 'Part ' || l_partkey AS title, l_extendedprice AS price, 'http://shop.example.com/p/' || l_partkey AS link FROM lineitem"
)
def extract_two_markups(spark, sf):
    """Returned lines wrap the title in one more element; the shortened selector finds both forms."""
    title = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("<span class='t'>Part "), _text("l_partkey"), F.lit("</span>"))).otherwise(F.concat(F.lit("Part "), _text("l_partkey")))
    card = F.concat(
        F.lit("<div class='card'><a class='s' href='/p/"), _text("l_partkey"), F.lit("'>"), title, F.lit("</a><i hidden>old</i><em>$ "), F.format_string("%.2f", "l_extendedprice"), F.lit("</em></div>")
    )
    rule = Rule("div.card", (Field("title", "a.s span.t", None, ("strip",), True), Field("price", ":scope > em", None, ("price",)), Field("link", "a", "href")))
    nodes = html_nodes(_order_pages(spark, sf, card), node_columns(rule), node_tags(rule), carry=("url",))
    return finish_rows(extract_dom(nodes, rule, ("url",)), rule).select("page_id", "title", "price", "link")


@query()
def fix_field_coverage(spark, sf):
    """Key and value rows whose value is a link in returned lines and plain text in others."""
    tag = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("<a class='n-a info_value' href='/p/"), _text("l_partkey"), F.lit("'>Part "), _text("l_partkey"), F.lit("</a>"))).otherwise(
        F.concat(F.lit("<div class='info_value'>Part "), _text("l_partkey"), F.lit("</div>"))
    )
    card = F.concat(F.lit("<div><div class='info_key'>Line number "), _text("l_linenumber"), F.lit("</div>"), tag, F.lit("</div>"))
    nodes = cut(html_nodes(_order_pages(spark, sf, card), D.NODE_COLUMNS))
    cands = cut(D.list_candidates(nodes))
    fields = cut(D.infer_fields(cands, nodes))
    return D.fix_field_coverage(fields, cands, nodes).select("page_id", "pos", "name", "selector", "attribute")


@query("SELECT page_id, 'a' AS selector, len(regexp_extract_all(html, '<li>')) AS n FROM pages WHERE len(regexp_extract_all(html, '<li>')) > 0")
def relative_selector(spark, sf):
    nodes = cut(html_nodes(read_pages(spark, f"{sf}/pages.parquet"), ["node_id", "depth", "tag", "path", "anc_ids"]))
    items = nodes.where("tag = 'li'").select("page_id", F.col("node_id").alias("item_id"), F.col("node_id").alias("rank"))
    inside = D.item_nodes(nodes, items).withColumn("item_depth", F.array_position("anc_ids", F.col("item_id")).cast("int") - 1)
    sel = D.relative_selector(inside.where("tag = 'a'"), inside)
    return sel.groupBy("page_id", "selector").agg(F.count("*").alias("n"))


@query(
    f"WITH {_LI} SELECT 'nav' AS rule_id, 'title' AS name, count(CASE WHEN txt <> '' THEN 1 END) AS filled FROM li "
    "UNION ALL SELECT 'nav', 'link', count(CASE WHEN href <> '' THEN 1 END) FROM li"
)
def validate_fields(spark, sf):
    """A column that repeats another in every row is dropped; one that is empty everywhere finds no replacement and is told."""
    pages = read_pages(spark, f"{sf}/pages.parquet")
    nodes = cut(html_nodes(pages, RT.NODE_COLUMNS, ["nav", "ul", "li", "a"]).withColumn("site", F.lit("any")))
    rule = Rule("nav li", (Field("title", "a"), Field("caption", "li a"), Field("link", "a", "href")))
    rules = validate_rules(spark.createDataFrame([("nav", "any", rule.to_json())], "rule_id string, site string, rule_json string"))
    analysed = rules.select("rule_id", F.lit("title").alias("name"), F.lit("b").alias("selector"), F.lit(None).cast("string").alias("attribute"))
    return RT.check_fields(RT.extract_by_rules(nodes, rules), rules, analysed).select("rule_id", "name", "filled")


_MAGIC = {"en": "4F67675300020000", "fr": "664C614300000022", "de": "89504E470D0A1A0A", "es": "FFD8FFE000104A46"}


@query(
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'ogg' WHEN 'fr' THEN 'flac' WHEN 'de' THEN 'png' ELSE 'jpeg' END AS kind,
    CASE WHEN lang IN ('de', 'es') THEN 'not playable: ' || (CASE lang WHEN 'de' THEN 'png' ELSE 'jpeg' END) END AS problem,
    CASE WHEN lang = 'fr' THEN '.flac' END AS rename_to FROM documents WHERE lang IN ('en', 'fr', 'de', 'es') AND strlen(text) >= 4"""
)
def verify_media(spark, sf):
    """Document texts behind the magic bytes of a container that goes with their language."""
    d = table(spark, sf, "documents").where(F.col("lang").isin(*_MAGIC) & (F.octet_length("text") >= 4))
    magic = F.unhex(F.element_at(F.create_map(*[F.lit(x) for kv in _MAGIC.items() for x in kv]), F.col("lang")))
    content = F.concat(magic, F.encode("text", "utf-8"))
    files = d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".ogg")).alias("path"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))
    v = M.verify_media(files)
    return v.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), "kind", "problem", "rename_to")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'ogg' WHEN 'fr' THEN 'flac' WHEN 'de' THEN 'png' ELSE 'jpeg' END AS kind FROM documents WHERE lang IN ('en', 'fr', 'de', 'es') AND strlen(text) >= 4")
def sniff_kinds(spark, sf):
    d = table(spark, sf, "documents").where(F.col("lang").isin(*_MAGIC) & (F.octet_length("text") >= 4))
    magic = F.unhex(F.element_at(F.create_map(*[F.lit(x) for kv in _MAGIC.items() for x in kv]), F.col("lang")))
    return d.select("doc_id", sniff_kind(F.concat(magic, F.encode("text", "utf-8"))).alias("kind"))


@query("SELECT event_id, upper(event_type) AS kind, CASE WHEN event_type = 'error' THEN 'ValueError: bad event' END AS problem FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS e, event_type FROM events) WHERE event_type <> 'error' UNION ALL SELECT event_id, 'error', 'ValueError: bad event' FROM events WHERE event_type = 'error'")
def row_steps(spark, sf):
    def shout(row):
        if row["kind"] == "error":
            raise ValueError("bad event")
        return {"event_id": row["event_id"], "kind": row["kind"].upper()}

    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"))
    return row_step(shout, "event_id bigint, kind string")(e, {}).withColumnRenamed("_error", "problem")


@query()
def page_signals(spark, sf):
    """Login state and challenge of every page; tests compare the operators with fixtures, SQL has no twin for their patterns."""
    nodes = cut(html_nodes(read_pages(spark, f"{sf}/pages.parquet"), R.TEXT_COLUMNS))
    pt = R.page_text(nodes)
    state = A.login_state(A.login_signals(nodes, pt)).select("page_id", "state")
    return state.join(A.challenge(A.challenge_signals(nodes, pt)).select("page_id", "challenged"), "page_id")


_ALL_MAGIC = {
    "mp4": "0000001866747970", "matroska": "1A45DFA3", "flv": "464C5601", "avi": "524946460000000041564920", "wav": "524946460000000057415645",
    "ogg": "4F676753", "flac": "664C6143", "webp": "524946460000000057454250", "png": "89504E470D0A1A0A", "jpeg": "FFD8FFE0",
    "mp3": "4944330400000000000000FFFB9000",
}


@query(
    "SELECT doc_id, CASE WHEN strlen(text) >= 12 THEN ["
    + ", ".join(f"'{k}'" for k in _ALL_MAGIC) + f"][doc_id % {len(_ALL_MAGIC)} + 1] END AS kind FROM documents WHERE strlen(text) >= 12"
)
def sniff_all_kinds(spark, sf):
    """Every document behind the first bytes of a container, each of eleven kinds."""
    d = table(spark, sf, "documents").where(F.octet_length("text") >= 12)
    heads = F.array(*[F.unhex(F.lit(x)) for x in _ALL_MAGIC.values()])
    head = F.get(heads, (F.col("doc_id") % len(_ALL_MAGIC)).cast("int"))
    return d.select("doc_id", sniff_kind(F.concat(head, F.encode("text", "utf-8"))).alias("kind"))
