"""Queries with rules as data: one plan for all sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webframe.functions.urls import url_part
from webframe.operators import rule_tables as RT
from webframe.operators.rules import Field, Rule, validate_rules
from webframe.plans.catalog import query
from webframe.plans.lineage import cut
from webframe.plans.queries_pages import _LI, _ROOT
from webframe.sources.nodes import html_nodes
from webframe.sources.pages import read_pages

#: One rule per top-level domain of the test pages; they differ in items, fields and steps.
SITE_RULES = {
    "com": Rule("nav ul > li", (Field("title", "a", None, ("strip",), True), Field("link", "a", "href", ("url",), True))),
    "net": Rule("ul:not(.menu) > li:nth-child(2n)", (Field("both", ":scope > a", "text_with_href"), Field("missing", "b", None), Field("upper", "li a[href^='/']", None, ("strip", "upper")))),
    "org": Rule("//nav/ul", (Field("first", "li a, td", None, ("strip", "lower")), Field("second", "li:nth-of-type(2) > :is(a, b)", "href"))),
}
_SITE = "regexp_extract(url, '://[^/?#]*\\.([a-z]+)', 1)"


def _rules(spark) -> DataFrame:
    """The rules above, as rows read from their JSON texts."""
    texts = [(site, site, rule.to_json()) for site, rule in SITE_RULES.items()]
    return validate_rules(spark.createDataFrame(texts, "rule_id string, site string, rule_json string"))


def _site_nodes(spark, sf) -> DataFrame:
    nodes = html_nodes(read_pages(spark, f"{sf}/pages.parquet"), RT.NODE_COLUMNS, carry=("url",))
    return cut(nodes.withColumn("site", F.regexp_extract(url_part("url", "netloc"), r"\.([a-z]+)$", 1)))


@query(
    f"""WITH {_LI}, s AS (SELECT *, {_SITE} AS site, count(*) OVER (PARTITION BY page_id) AS n FROM li),
    v AS (SELECT 'com' AS rule_id, page_id, pos AS nth, 'title' AS name, txt AS value FROM s WHERE site = 'com' AND txt <> ''
    UNION ALL SELECT 'com', page_id, pos, 'link', {_ROOT} || href FROM s WHERE site = 'com' AND txt <> ''
    UNION ALL SELECT 'net', page_id, pos // 2, 'both', CASE WHEN txt = '' THEN href ELSE txt || chr(10) || href END FROM s WHERE site = 'net' AND pos % 2 = 0
    UNION ALL SELECT 'net', page_id, pos // 2, 'missing', NULL FROM s WHERE site = 'net' AND pos % 2 = 0
    UNION ALL SELECT 'net', page_id, pos // 2, 'upper', upper(txt) FROM s WHERE site = 'net' AND pos % 2 = 0
    UNION ALL SELECT 'org', page_id, 1, 'first', max(CASE WHEN pos = 1 THEN lower(txt) END) FROM s WHERE site = 'org' GROUP BY page_id
    UNION ALL SELECT 'org', page_id, 1, 'second', max(CASE WHEN pos = 2 THEN href END) FROM s WHERE site = 'org' GROUP BY page_id),
    r AS (SELECT rule_id, page_id, name, value, row_number() OVER (PARTITION BY rule_id, page_id, name ORDER BY nth) AS nth FROM v)
    SELECT rule_id, page_id, nth, name, value FROM r"""
)
def extract_by_rules(spark, sf):
    """Three sites, three rules, one plan: items, fields with fallbacks, cleaning, required fields."""
    nodes, rules = _site_nodes(spark, sf), _rules(spark)
    items = RT.extract_by_rules(nodes, rules).join(nodes.select("page_id", "url").distinct(), "page_id")
    done = RT.finish_by_rules(items, rules)
    d = done.select("rule_id", "page_id", "item_id", F.explode("data").alias("name", "value"))
    nth = F.row_number().over(Window.partitionBy("rule_id", "page_id", "name").orderBy("item_id"))
    return d.select("rule_id", "page_id", nth.alias("nth"), "name", "value")


@query(
    f"""WITH {_LI}, s AS (SELECT *, {_SITE} AS site FROM li),
    u AS (SELECT page_id, site, max(CASE WHEN pos = 1 THEN txt END) AS one, max(CASE WHEN pos = 2 THEN href END) AS two FROM s GROUP BY 1, 2)
    SELECT 'com' AS rule_id, 'title' AS name, 'a' AS selector, count_if(txt <> '') AS filled, FALSE AS replaced FROM s WHERE site = 'com'
    UNION ALL SELECT 'com', 'link', 'a', count_if(href <> ''), FALSE FROM s WHERE site = 'com'
    UNION ALL SELECT 'net', 'both', ':scope > a', count(*), FALSE FROM s WHERE site = 'net' AND pos % 2 = 0
    UNION ALL SELECT 'net', 'missing', 'a', 0, TRUE
    UNION ALL SELECT 'net', 'upper', 'li a[href^=''/'']', count_if(txt <> ''), FALSE FROM s WHERE site = 'net' AND pos % 2 = 0
    UNION ALL SELECT 'org', 'first', 'li a, td', count_if(one <> ''), FALSE FROM u WHERE site = 'org'
    UNION ALL SELECT 'org', 'second', 'li:nth-of-type(2) > :is(a, b)', count_if(two <> ''), FALSE FROM u WHERE site = 'org'"""
)
def check_fields_by_rule(spark, sf):
    """Fields of all rules checked in one grouping; one that is always empty takes the analysed selector, a copy of another goes."""
    nodes, rules = _site_nodes(spark, sf), _rules(spark)
    copy = F.struct(F.lit("caption").alias("name"), F.lit("nav li a").alias("selector"), F.lit("href").alias("attribute"),
                    F.array().cast("array<string>").alias("transform"), F.lit(False).alias("required"))
    fields = F.when(F.col("rule_id") == "com", F.array_append("list_rule.fields", copy)).otherwise(F.col("list_rule.fields"))
    rules = rules.withColumn("list_rule", F.col("list_rule").withField("fields", fields))
    analysed = rules.select("rule_id", F.lit("missing").alias("name"), F.lit("a").alias("selector"), F.lit(None).cast("string").alias("attribute"))
    out = RT.check_fields(cut(RT.extract_by_rules(nodes, rules)), rules, analysed)
    return out.select("rule_id", "name", "selector", "filled", "replaced")


@query(
    f"""SELECT page_id, site AS rule_id, CASE WHEN n > 0 THEN 'nav li > a' ELSE 'a.next' END AS next_selector, n AS hits
    FROM (SELECT page_id, {_SITE} AS site, len(regexp_extract_all(html, '<li>')) AS n FROM pages) WHERE site = 'com'
    UNION ALL SELECT page_id, {_SITE}, 'a.next', 0 FROM pages WHERE {_SITE} = 'net'
    UNION ALL SELECT page_id, {_SITE}, NULL, 0 FROM pages WHERE {_SITE} = 'org'"""
)
def check_pagination_by_rule(spark, sf):
    """Next selectors of all rules at once: one that hits, one that does not, and a rule without."""
    nodes, rules = _site_nodes(spark, sf), _rules(spark)
    own = F.when(F.col("rule_id") == "com", "nav li > a").when(F.col("rule_id") == "net", "div.pager a")
    rules = rules.withColumn("pagination", F.when(own.isNotNull(), F.struct(own.alias("next_selector"), F.lit(3).alias("max_pages"))))
    paging = nodes.select("page_id").distinct().withColumn("next_selector", F.lit("a.next"))
    return RT.check_pagination(nodes, rules, paging)
