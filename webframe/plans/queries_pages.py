"""Queries on the page corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.functions import urls as U
from webframe.functions.media import media_score, media_url_ok
from webframe.operators import items as I
from webframe.operators import media as M
from webframe.operators import paging as G
from webframe.operators import repair as P
from webframe.operators import report as R
from webframe.operators import structure as D
from webframe.operators.extract import extract_dom, finish_rows, node_columns, node_tags
from webframe.operators import rules as L
from webframe.operators.rules import Field, Rule
from webframe.operators.selectors import select_nodes
from webframe.plans.catalog import query
from webframe.plans.lineage import cut
from webframe.sources.nodes import html_nodes
from webframe.sources.pages import read_pages

NAV_RULE = Rule(
    "nav ul > li",
    (Field("title", "a", None, ("strip",), True), Field("link", "a", "href", ("url",), True)),
)


def _pages(spark, sf):
    return read_pages(spark, f"{sf}/pages.parquet")


def _decoded(x: str) -> str:
    x = f"regexp_replace({x}, '&quot;?', '\"', 'g')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


_LI = f"""li AS (
  SELECT page_id, url, pos, {_decoded("regexp_extract(x, 'href=\"([^\"]*)\"', 1)")} AS href,
         trim({_decoded("regexp_extract(x, '>([^<]*)</a>', 1)")}) AS txt
  FROM (SELECT page_id, url, unnest(l) AS x, generate_subscripts(l, 1) AS pos
        FROM (SELECT page_id, url, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS l FROM pages)))"""
_ROOT = "regexp_extract(url, '^[a-z]+://[^/?#]+')"
_H1 = f"trim(regexp_replace({_decoded(chr(34) + 'h' + chr(34))}, '\\s+', ' ', 'g'))"
_N = "len(regexp_extract_all(html, '{}'))"


@query("SELECT page_id, url, length(html) AS n_chars FROM pages")
def scan_pages(spark, sf):
    return _pages(spark, sf).select("page_id", "url", F.length("html").alias("n_chars"))


@query(
    "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) GROUP BY 1, 2"
)
def element_rows(spark, sf):
    return html_nodes(_pages(spark, sf), ["tag"]).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(
    f"SELECT page_id, {_N.format('<[a-z]')} AS total_elements, {_N.format('<a href=')} AS links, {_N.format('<img')} AS images, "
    f"{_N.format('<iframe')} AS iframes, {_N.format('<form')} AS forms FROM pages"
)
def dom_stats(spark, sf):
    return R.dom_stats(html_nodes(_pages(spark, sf), ["tag", "attrs"]))


@query(f"WITH {_LI} SELECT page_id, href, txt FROM li")
def select_css(spark, sf):
    nodes = html_nodes(_pages(spark, sf), ["node_id", "depth", "tag", "path", "attrs", "text"], ["a"])
    return select_nodes(nodes, "nav li > a[href]").select("page_id", F.element_at("attrs", "href").alias("href"), F.col("text").alias("txt"))


_PLACES = {
    "nav li:nth-child(2) > a": "pos = 2", "nav li:nth-child(2n+1) > a": "pos % 2 = 1", "nav li:nth-last-child(2) a": "pos = n - 1",
    "nav li:first-child a": "pos = 1", "nav li:last-child > a": "pos = n", "nav li:not(:first-child) a[href]": "pos > 1",
    "nav li:first-child + li a": "pos = 2", "nav li:nth-child(2) ~ li > a": "pos > 2", "nav li:only-child a": "n = 1",
}


@query(
    f"WITH {_LI}, c AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM li) "
    + " UNION ALL ".join(f"SELECT '{css}' AS css, page_id, href FROM c WHERE {cond}" for css, cond in _PLACES.items())
)
def select_by_place(spark, sf):
    """Selectors by place among siblings, by negation and by sibling combinators."""
    nodes = cut(html_nodes(_pages(spark, sf), ["node_id", "parent_id", "sib_pos", "sib_count", "depth", "tag", "path", "attrs", "anc_ids"], ["li", "a"]))
    found = [select_nodes(nodes, css).select(F.lit(css).alias("css"), "page_id", F.element_at("attrs", "href").alias("href")) for css in _PLACES]
    return reduce(DataFrame.union, found)


@query(f"SELECT page_id, {_H1} AS txt FROM (SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h FROM pages)")
def select_xpath(spark, sf):
    nodes = html_nodes(_pages(spark, sf), ["node_id", "depth", "tag", "path", "attrs", "text"], ["h1"])
    return select_nodes(nodes, "//article/h1").select("page_id", F.regexp_replace("text", r"\s+", " ").alias("txt"))


def _nav_items(spark, sf):
    nodes = html_nodes(_pages(spark, sf), node_columns(NAV_RULE), node_tags(NAV_RULE), carry=("url",))
    return finish_rows(extract_dom(nodes, NAV_RULE, ("url",)), NAV_RULE)


@query(f"WITH {_LI} SELECT page_id, url, txt AS title, {_ROOT} || href AS link FROM li WHERE txt <> ''")
def extract_list(spark, sf):
    return _nav_items(spark, sf).select("page_id", "url", "title", "link")


@query(
    f"WITH {_LI} SELECT host, count(*) AS items, count(DISTINCT page_id) AS pages FROM (SELECT DISTINCT regexp_extract(url, '://([^/?#]+)', 1) AS host, page_id, txt, href FROM li WHERE txt <> '') GROUP BY 1"
)
def nav_items_by_host(spark, sf):
    """Whole chain: read, extract, clean, dedupe per page, count per host."""
    items = I.dedupe_first(_nav_items(spark, sf), ["title", "link"], ["item_id"], ["page_id"])
    return items.groupBy(U.url_part("url", "netloc").alias("host")).agg(
        F.count("*").alias("items"), F.count_distinct("page_id").alias("pages")
    )


@query(f"WITH {_LI} SELECT page_id, pos AS nth, CASE WHEN txt = '' THEN href ELSE txt || chr(10) || href END AS both_text FROM li")
def text_with_href(spark, sf):
    rule = Rule("nav li", (Field("both_text", "a", "text_with_href"),))
    nodes = html_nodes(_pages(spark, sf), [*node_columns(rule), "nth_of_type"], node_tags(rule))
    nth = nodes.where("tag = 'li'").select("page_id", F.col("node_id").alias("item_id"), F.col("nth_of_type").alias("nth"))
    return extract_dom(nodes, rule).join(nth, ["page_id", "item_id"]).select("page_id", "nth", "both_text")


@query(f"WITH {_LI} SELECT page_id, href, pos AS nth FROM li")
def nth_of_type(spark, sf):
    nodes = html_nodes(_pages(spark, sf), ["node_id", "parent_id", "nth_of_type", "tag", "attrs"], ["li", "a"])
    li = nodes.where("tag = 'li'").select("page_id", F.col("node_id").alias("parent_id"), F.col("nth_of_type").alias("nth"))
    a = nodes.where("tag = 'a'").select("page_id", "parent_id", F.element_at("attrs", "href").alias("href"))
    return a.join(li, ["page_id", "parent_id"]).select("page_id", "href", "nth")


@query("SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[a-z]')) AS inside FROM pages")
def descendant_join(spark, sf):
    nodes = html_nodes(_pages(spark, sf), ["node_id", "end_id", "tag", "anc_ids"])
    items = nodes.where("tag = 'article'").select("page_id", F.col("node_id").alias("item_id"))
    return D.item_nodes(nodes, items, ()).groupBy("page_id").agg(F.count("*").alias("inside"))


@query(
    "SELECT page_id, 0 AS n_json_ld, 0 AS n_open_graph, 0 AS n_microdata, "
    + "regexp_replace(trim(" + _decoded("regexp_extract(html, '<title>(.*?)</title>', 1)") + "), '\\s+', ' ', 'g') AS title FROM pages"
)
def structured_metadata(spark, sf):
    nodes = html_nodes(_pages(spark, sf), ["node_id", "tag", "attrs", "own_text", "text"], None)
    meta = R.structured_metadata(nodes).select(
        "page_id", F.size("json_ld").alias("n_json_ld"), F.size("open_graph").alias("n_open_graph"), F.size("microdata").alias("n_microdata")
    )
    titles = R.page_titles(nodes).select("page_id", F.regexp_replace("title", r"\s+", " ").alias("title"))
    out = titles.join(meta, "page_id", "left")
    return out.select("page_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_json_ld", "n_open_graph", "n_microdata")], "title")


@query(
    f"SELECT page_id, {_N.format('<[a-z]')} AS dom_nodes, {_N.format('<a href=')} AS interactive_count, 0 AS n_forms, "
    + "regexp_replace(substr(trim(regexp_replace(" + _decoded("regexp_extract(html, '<h1>(.*?)</h1>', 1)") + ", '[ \\t]+', ' ', 'g')), 1, 160), '\\s+', ' ', 'g') AS h1 FROM pages"
)
def page_text(spark, sf):
    pt = R.page_text(html_nodes(_pages(spark, sf), R.TEXT_COLUMNS))
    return pt.select("page_id", "dom_nodes", "interactive_count", F.size("forms").alias("n_forms"), F.regexp_replace(F.get("headings", F.lit(0))["text"], r"\s+", " ").alias("h1"))


@query(
    "SELECT page_id, 'heading' AS role, 1 AS pos, substr(trim(regexp_replace(" + _decoded("regexp_extract(html, '<h1>(.*?)</h1>', 1)") + ", '\\s+', ' ', 'g')), 1, 160) AS txt FROM pages"
)
def text_elements(spark, sf):
    pt = R.page_text(html_nodes(_pages(spark, sf), R.TEXT_COLUMNS))
    return R.text_elements(pt).select("page_id", "role", "pos", F.trim("text").alias("txt"))


@query()
def simplified_tree(spark, sf):
    return R.simplified_tree(cut(html_nodes(_pages(spark, sf), R.TREE_COLUMNS))).select("page_id", "nodes", "truncated_nodes", "images_in_dom", "image_coverage", "tree")


@query(
    "SELECT page_id, 'ul > li' AS item_selector, 'ul' AS container_selector, count(*) AS \"count\" FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>')) FROM pages) GROUP BY 1 HAVING count(*) >= 3"
)
def list_candidates(spark, sf):
    c = D.list_candidates(cut(html_nodes(_pages(spark, sf), D.LIST_COLUMNS)))
    return c.where("tag = 'li'").select("page_id", "item_selector", "container_selector", "count")


@query(
    "SELECT page_id, t.tag, t.selector FROM pages, (VALUES ('nav', 'nav'), ('ul', 'ul'), ('article', 'article'), ('div', 'div.ad'), ('h1', 'h1'), ('footer', 'footer')) AS t(tag, selector)"
)
def unique_selector(spark, sf):
    nodes = cut(html_nodes(_pages(spark, sf), ["node_id", "tag", "elem_id", "classes", "attrs", "path"]))
    marks = nodes.where(F.col("tag").isin("nav", "ul", "article", "div", "h1", "footer"))
    return D.unique_selector(nodes, marks).join(marks.select("page_id", "node_id", "tag"), ["page_id", "node_id"]).select("page_id", "tag", "selector")


def _candidates(spark, sf, where="tag = 'li'"):
    nodes = cut(html_nodes(_pages(spark, sf), D.NODE_COLUMNS, carry=("url",)))
    return nodes, cut(D.list_candidates(nodes).where(where))


@query(
    "SELECT page_id, 'a' AS selector, t.attribute FROM (SELECT page_id FROM pages WHERE len(regexp_extract_all(html, '<li>')) >= 3), (VALUES (NULL), ('href'), ('text_with_href')) AS t(attribute)"
)
def infer_fields(spark, sf):
    nodes, cands = _candidates(spark, sf)
    return D.infer_fields(cands, nodes).select("page_id", "selector", "attribute")


@query()
def build_rules(spark, sf):
    """Best candidate of every site as a rule, with how many pages the site has."""
    pages = _pages(spark, sf)
    nodes, cands = _candidates(spark, sf, "true")
    full = D.with_fields(cands, D.infer_fields(cands, nodes))
    site = pages.select("page_id", U.site_slug("url").alias("site"))
    rules = D.build_rules(full.join(site, "page_id"), by="site")
    return rules.select("site", "list_rule.item_selector", F.size("list_rule.fields").alias("n_fields"), "score", "count")


@query(
    "SELECT page_id, \"count\" >= 8 AS is_data, \"count\" FROM (SELECT page_id, count(*) AS \"count\" FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>')) FROM pages) GROUP BY 1 HAVING count(*) >= 3)"
)
def candidate_looks_like_data(spark, sf):
    c = D.list_candidates(cut(html_nodes(_pages(spark, sf), D.LIST_COLUMNS))).where("tag = 'li'")
    return c.select("page_id", D.looks_like_data("item_selector", "container_selector", "count").alias("is_data"), "count")


_P_TEXTS = """list_filter(list_transform(string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')[2:],
    lambda c: trim(regexp_replace(regexp_replace(regexp_replace(c, '<[^>]*>', '', 'g'), '&(amp|quot|copy|middot);?', 'x', 'g'), '\\s+', ' ', 'g'))), lambda t: length(t) > 10)"""


@query(
    f"SELECT page_id, len({_P_TEXTS}) >= 3 OR {_N.format('<li>')} >= 8 OR {_N.format('<a href=')} >= 20 AS has_content FROM pages"
)
def page_has_content(spark, sf):
    nodes = cut(html_nodes(_pages(spark, sf), D.LIST_COLUMNS))
    return D.page_has_content(D.list_candidates(nodes), R.dom_stats(nodes))


@query(
    "SELECT page_id, 'ul > li' AS item_selector, len(regexp_extract_all(html, '<li>')) AS \"count\" FROM pages WHERE len(regexp_extract_all(html, '<li>')) >= 3"
)
def scope_region(spark, sf):
    return D.list_candidates(cut(html_nodes(_pages(spark, sf), D.LIST_COLUMNS)), scope="nav").select("page_id", "item_selector", "count")


@query("SELECT page_id, 1 AS fields_left, 'ul > li' AS item_selector FROM pages WHERE len(regexp_extract_all(html, '<li>')) >= 3")
def merge_fields(spark, sf):
    """Complete sparse rules (text only) with analysed fields, then count what is new."""
    nodes, cands = _candidates(spark, sf)
    analysed = D.infer_fields(cands, nodes).select(F.col("page_id").alias("rule_id"), "name", "selector", "attribute")
    rule = cands.select(
        F.col("page_id").alias("rule_id"), F.lit("text").alias("name"), F.lit("a").alias("selector"), F.lit(None).cast("string").alias("attribute"),
        F.lit("ai").alias("source"), "item_selector",
    ).unionByName(
        cands.select(
            F.col("page_id").alias("rule_id"), F.lit("link").alias("name"), F.lit("a").alias("selector"), F.lit("href").alias("attribute"),
            F.lit("ai").alias("source"), "item_selector",
        )
    )
    out = P.merge_fields(rule, analysed)
    return out.groupBy("rule_id").agg(F.count_if("added").alias("fields_left"), F.first("item_selector", True).alias("item_selector")).withColumnRenamed("rule_id", "page_id")


@query("SELECT page_id, 2 AS kept FROM pages WHERE len(regexp_extract_all(html, '<li>')) >= 3")
def drop_redundant_fields(spark, sf):
    nodes, cands = _candidates(spark, sf)
    base = cands.select("page_id", "rank", F.lit("title").alias("name"), F.lit("a").alias("selector"), F.lit(None).cast("string").alias("attribute"))
    f = base.unionByName(base.withColumn("name", F.lit("s-fc7"))).unionByName(base.withColumn("name", F.lit("link")).withColumn("attribute", F.lit("href")))
    return D.drop_redundant_fields(f).groupBy("page_id").agg(F.count("*").alias("kept"))


def _with_pager(pages):
    """Whole pages, with an unlabelled pager ahead that points at pages 1 to 3."""
    pager = "".join(f'<a href="?page={i}"></a>' for i in (1, 2, 3))
    return pages.withColumn("html", F.regexp_replace("html", "<body>", f'<body><div class="pager">{pager}</div>'))


@query(
    "SELECT page_id, 'page-param' AS strategy, cur AS current_page, '?page=' || (cur + 1) AS next_href FROM (SELECT page_id, coalesce(try_cast(nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), '') AS INTEGER), 1) AS cur FROM pages) WHERE cur < 3"
)
def pagination(spark, sf):
    nodes = cut(html_nodes(_with_pager(_pages(spark, sf)), G.NODE_COLUMNS, carry=("url",)))
    return G.pagination(nodes, with_selector=False).select("page_id", "strategy", "current_page", "next_href")


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'rel-next' ELSE 'numeric' END AS strategy,
    CASE page_id % 4 WHEN 0 THEN '/after-' WHEN 1 THEN '/rel-' ELSE '/page-3-' END || page_id AS next_href FROM pages WHERE page_id % 4 < 3"""
)
def pagination_kinds(spark, sf):
    """Whole pages with a labelled link, a ``rel=next`` link or a numeric pager; a quarter have none."""
    n = F.col("page_id").cast("string")
    link = lambda head, path, tail: F.concat(F.lit(f"{head} href='/{path}-"), n, F.lit(f"'>{tail}"))
    kinds = [
        link("<p><a", "before", "Previous</a>"), link("<a", "after", "Next page</a></p>"), link("<p><a rel='next'", "rel", "more</a></p>"),
        F.concat(link("<div class='pages'><a", "page-1", "1</a><span class='current'>2</span>"), link("<a", "page-3", "3</a></div>")),
    ]
    pager = F.when(F.col("page_id") % 4 == 0, F.concat(kinds[0], kinds[1])).when(F.col("page_id") % 4 == 1, kinds[2]).when(F.col("page_id") % 4 == 2, kinds[3]).otherwise("")
    pages = _pages(spark, sf).withColumn("html", F.regexp_replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), pager)))
    # addresses without a page number, so that only the pager speaks
    pages = pages.withColumn("url", F.regexp_replace("url", r"[?#].*$", ""))
    nodes = cut(html_nodes(pages, G.NODE_COLUMNS, carry=("url",)))
    return G.pagination(nodes, with_selector=False).select("page_id", "strategy", "next_href")


@query(
    """SELECT page_id, 'Item ' || page_id AS og_title, CASE WHEN page_id % 2 = 0 THEN '/i/' || page_id || '.jpg' END AS og_image, page_id AS sku,
    CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS blocks, ['price:' || (page_id % 90), 'name:Thing ' || page_id] AS micro FROM pages"""
)
def metadata_values(spark, sf):
    """JSON-LD, Open Graph and microdata put into the pages and read back; a broken JSON-LD block is skipped."""
    n = F.col("page_id").cast("string")
    lit = F.lit
    head = F.concat(
        lit("<head><meta property='og:title' content='first'><meta property='og:title' content='Item "), n, lit("'>"),
        F.when(F.col("page_id") % 2 == 0, F.concat(lit("<meta property='og:image' content='/i/"), n, lit(".jpg'>"))).otherwise(""),
        lit("<script type='application/ld+json'>{\"sku\": "), n, lit("}</script><script type='application/ld+json'>{\"sku\": </script>"),
        F.when(F.col("page_id") % 3 == 0, lit("<script type='application/ld+json'>[1, 2]</script>")).otherwise(""),
    )
    body = F.concat(lit("<body><div><meta itemprop='price' content='"), (F.col("page_id") % 90).cast("string"), lit("'><b itemprop='name'>Thing "), n, lit("</b></div>"))
    html = F.regexp_replace(F.regexp_replace("html", lit("<head>"), head), lit("<body>"), body)
    nodes = html_nodes(_pages(spark, sf).withColumn("html", html), ["node_id", "tag", "attrs", "own_text", "text"])
    m = R.structured_metadata(nodes)
    micro = F.transform("microdata", lambda x: F.concat(x["itemprop"], lit(":"), F.coalesce(x["content"], x["text"])))
    return m.select(
        "page_id", F.try_element_at("open_graph", lit("og:title")).alias("og_title"), F.try_element_at("open_graph", lit("og:image")).alias("og_image"),
        F.get_json_object(F.get("json_ld", lit(0)), "$.sku").cast("bigint").alias("sku"), F.size("json_ld").alias("blocks"), micro.alias("micro"),
    )


@query(
    "SELECT page_id, 0 AS hits, 'div.pager' IS NOT NULL AND coalesce(try_cast(nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), '') AS INTEGER), 1) < 3 AS has_fallback FROM pages"
)
def validate_pagination(spark, sf):
    pages = _with_pager(_pages(spark, sf))
    nodes = cut(html_nodes(pages, G.NODE_COLUMNS, carry=("url",)))
    rule = Rule("li", (), next_selector="a.no-such-class")
    out = P.validate_pagination(pages, nodes, rule, G.pagination(nodes))
    return out.select("page_id", "hits", F.col("next_selector").isNotNull().alias("has_fallback"))


@query(
    """SELECT g AS page_id, arg_max(d, o) AS doc_no FROM (SELECT page_id // 3 AS g, page_id % 3 AS d,
       {'s': 0, 'c': len(regexp_extract_all(html, '<li>')), 'e': len(regexp_extract_all(html, '<[a-z]')), 'i': 0, 'd': -(page_id % 3)} AS o FROM pages) GROUP BY 1"""
)
def richest_document(spark, sf):
    nodes = html_nodes(_pages(spark, sf), ["tag"])
    docs = nodes.groupBy("page_id").agg(F.count_if(F.col("tag") == "li").alias("candidates"), F.count("*").alias("elements"))
    docs = docs.select(
        F.floor(F.col("page_id") / 3).cast("long").alias("page_id"), (F.col("page_id") % 3).alias("doc_no"),
        F.lit(False).alias("scope_matched"), "candidates", "elements", F.lit(0).alias("images"),
    )
    return R.richest_document(docs).select("page_id", "doc_no")


@query(
    """WITH a AS (SELECT regexp_replace(url, '#.*$', '') AS u, min(page_id) AS to_id FROM pages GROUP BY 1),
    e AS (SELECT p.page_id, a.to_id FROM pages p JOIN pages n ON n.page_id = p.page_id + 1 JOIN a ON a.u = regexp_replace(n.url, '#.*$', '')),
    s AS (SELECT page_id AS start_id, 1 AS step, page_id FROM pages
          UNION ALL SELECT e1.page_id, 2, e1.to_id FROM e e1 WHERE e1.to_id <> e1.page_id
          UNION ALL SELECT e1.page_id, 3, e2.to_id FROM e e1 JOIN e e2 ON e2.page_id = e1.to_id WHERE e1.to_id <> e1.page_id AND e2.to_id NOT IN (e1.page_id, e1.to_id)),
    t AS (SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h FROM pages),
    f AS (SELECT start_id, h, min(step) AS step FROM s JOIN t USING (page_id) GROUP BY 1, 2),
    st AS (SELECT start_id, min(step) AS stop FROM (SELECT start_id, step FROM s WHERE step > 1 EXCEPT SELECT start_id, step FROM f) GROUP BY 1)
    SELECT start_id, step, page_id FROM s LEFT JOIN st USING (start_id) WHERE stop IS NULL OR step <= stop"""
)
def follow_pages(spark, sf):
    pages = _pages(spark, sf)
    nxt = pages.select((F.col("page_id") - 1).alias("page_id"), F.regexp_replace("url", "#.*$", "").alias("next_url"))
    edges = pages.select("page_id").join(nxt, "page_id")
    items = pages.select("page_id", F.md5(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("content_hash"))
    return G.follow_pages(pages.select("page_id", "url"), edges, items, 3, starts=pages).select("start_id", "step", "page_id")


@query(
    """WITH RECURSIVE a AS (SELECT regexp_replace(url, '#.*$', '') AS u, min(page_id) AS to_id FROM pages GROUP BY 1),
    e AS (SELECT p.page_id, a.to_id FROM pages p JOIN pages n ON n.page_id = p.page_id + 1 JOIN a ON a.u = regexp_replace(n.url, '#.*$', '') WHERE a.to_id <> p.page_id),
    c AS (SELECT page_id AS start_id, 1 AS step, page_id, [page_id] AS trail FROM pages WHERE page_id NOT IN (SELECT to_id FROM e)
          UNION ALL SELECT c.start_id, c.step + 1, e.to_id, list_append(c.trail, e.to_id) FROM c JOIN e ON e.page_id = c.page_id WHERE NOT list_contains(c.trail, e.to_id))
    SELECT start_id, step, page_id FROM c"""
)
def page_chains(spark, sf):
    """Chains from the pages that no link leads to; each page links to the one with the next number."""
    pages = _pages(spark, sf).select("page_id", "url")
    edges = pages.select((F.col("page_id") - 1).alias("page_id"), F.regexp_replace("url", "#.*$", "").alias("next_url")).join(pages.select("page_id"), "page_id")
    return G.page_chains(pages, edges)


@query(f"WITH {_LI} SELECT page_id, url, position FROM (SELECT page_id, u AS url, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS position FROM (SELECT page_id, {_ROOT} || href AS u, min(pos) AS pos FROM li GROUP BY 1, 2))")
def collect_media_urls(spark, sf):
    pages = _pages(spark, sf)
    nodes = html_nodes(pages, ["node_id", "depth", "tag", "path", "attrs"], ["a"])
    links = M.dom_urls(nodes, "nav a", "href").select("page_id", F.col("node_id").alias("seq"), "url")
    return M.collect_media_urls([links, links], pages).select("page_id", "url", "position")


@query(f"WITH {_LI} SELECT page_id, {_ROOT} || href AS url FROM li WHERE length(href) * 10 = 0 OR length(href) * 10 >= 60")
def min_width(spark, sf):
    items = _nav_links(spark, sf)
    wide = M.min_width(items, items.select("page_id", "url", (F.length("href") * 10).alias("width")), 60)
    return wide.select("page_id", "url")


def _nav_links(spark, sf):
    pages = _pages(spark, sf)
    nodes = html_nodes(pages, ["node_id", "depth", "tag", "path", "attrs"], ["a"], carry=("url",))
    href = F.element_at("attrs", "href")
    return select_nodes(nodes, "nav a[href]").select("page_id", href.alias("href"), F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0), href).alias("url"))


@query(
    f"""WITH b AS (SELECT page_id, url, {_ROOT} AS root, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages),
    c AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END AS folder FROM b)
    SELECT page_id, root || '/a/c?x=/../' AS dots, root || path || '?z=1' AS by_query, regexp_replace(url, '#.*$', '') || '#f' AS by_fragment,
      root || folder || 'rel/x.html' AS relative, root || regexp_replace(folder, '[^/]+/$', '') || 'up' AS parent,
      regexp_extract(url, '^[a-z]+:') || '//cdn.example.org/y' AS by_scheme FROM c"""
)
def resolve_urls(spark, sf):
    r = lambda rel: U.resolve_url("url", F.lit(rel))
    return _pages(spark, sf).select(
        "page_id", r("/a/./b/../c?x=/../").alias("dots"), r("?z=1").alias("by_query"), r("#f").alias("by_fragment"),
        r("rel/x.html").alias("relative"), r("../up").alias("parent"), r("//cdn.example.org/y").alias("by_scheme"),
    )


@query(
    """WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
      regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)
    SELECT page_id, host, substr(regexp_replace(regexp_replace(host || replace(path, '/', '_') || CASE WHEN q <> '' THEN '_' || substr(sha1(q), 1, 6) ELSE '' END, '[^A-Za-z0-9._-]', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 1, 80) AS slug,
      regexp_replace(host, '[^A-Za-z0-9._-]', '_', 'g') AS site FROM p"""
)
def url_slugs(spark, sf):
    return _pages(spark, sf).select("page_id", U.url_host("url").alias("host"), U.url_slug("url").alias("slug"), U.site_slug("url").alias("site"))


@query(
    """WITH p AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS path FROM pages),
    n AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS name FROM p)
    SELECT page_id, CASE WHEN regexp_matches(name, '\\.[A-Za-z0-9]{1,5}$') THEN regexp_extract(name, '^(.*)\\.[^.]*$', 1) || '_' || substr(md5(url), 1, 10) || regexp_extract(name, '\\.[A-Za-z0-9]{1,5}$')
      ELSE name || '_' || substr(md5(url), 1, 10) || '.bin' END AS file_name,
      CASE WHEN regexp_matches(path, '\\.html$') THEN '.html' ELSE '.bin' END AS ext, FALSE AS is_stream FROM n"""
)
def file_names(spark, sf):
    return _pages(spark, sf).select(
        "page_id", U.safe_filename("url").alias("file_name"), U.guess_extension(F.lit(""), "url").alias("ext"), U.is_stream_url("url").alias("is_stream")
    )


@query("SELECT page_id, url AS inner_url FROM pages")
def inner_urls(spark, sf):
    wrapped = F.concat(F.lit("https://proxy.example.com/get?x=1&file="), F.url_encode(F.url_encode("url")))
    return _pages(spark, sf).select("page_id", F.explode(U.inner_urls(wrapped)).alias("inner_url"))


@query(
    """SELECT page_id, NOT regexp_matches(url, '(?i)\\.html?($|[?#])') AND NOT regexp_matches(url, '(?i)/log/|log\\.|track|report|ads?[/_.-]|update|client|collect|banner|advert|monitor') AS media_ok,
    CASE WHEN regexp_matches(url, '(?i)\\.html?($|[?#])') THEN 0 WHEN regexp_matches(url, '(?i)/log/|log\\.|track|report|ads?[/_.-]|update|client|collect|banner|advert|monitor') THEN -50
    ELSE 20 + CASE WHEN url LIKE 'https://%' THEN 2 ELSE 0 END END AS score FROM pages"""
)
def media_url_score(spark, sf):
    return _pages(spark, sf).select("page_id", media_url_ok("url").alias("media_ok"), media_score("url", "playUrl").alias("score"))


@query(
    """SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN replace(url, '/en/', '/full/en/') WHEN url LIKE '%?page=%' THEN regexp_replace(url, '\\?page=\\d+', '') ELSE url END AS original,
    CASE WHEN url LIKE '%/en/%' THEN 0 WHEN url LIKE '%?page=%' THEN 1 END AS rule FROM pages"""
)
def thumb_to_original(spark, sf):
    hit = M.thumb_to_original("url", [("/en/", "/full/en/"), (r"\?page=\d+", "")])
    return _pages(spark, sf).withColumn("t", hit).select("page_id", F.col("t.url").alias("original"), F.col("t.rule").alias("rule"))


def _picture_pairs(pages):
    """Addresses of small and full pictures in four styles, made from the pages' paths."""
    stem, n = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^?#]*", 0), "/$", ""), F.col("page_id")
    kind, k = n % 4, n.cast("string")
    made = lambda a, b: F.struct(F.concat(stem, *a).alias("thumb"), F.concat(stem, *b).alias("original"))
    lit = F.lit
    pair = (
        F.when(kind == 0, made([lit("/x.thumb.400_0.jpeg")], [lit("/x.thumb.1000_0.jpeg")]))
        .when(kind == 1, made([lit("/c/250x250_80/img/"), k, lit("_p0_square1200.jpg")], [lit("/img/"), k, lit("_p0_master1200.jpg")]))
        .when(kind == 2, made([lit("/small/i"), k, lit(".png")], [lit("/large/i"), k, lit(".png")]))
        .otherwise(made([lit("/same.gif")], [lit("/same.gif")]))
    )
    return pages.select(n.alias("seq"), pair.alias("p")).select("seq", "p.*")


@query(
    r"""SELECT CASE page_id % 4 WHEN 0 THEN '(?<![A-Za-z0-9])400_0(?![A-Za-z0-9])' WHEN 1 THEN '(?<![A-Za-z0-9])c\/250x250_80\/(.*?)(?<![A-Za-z0-9])square1200(?![A-Za-z0-9])'
      ELSE '(?<![A-Za-z0-9])small(?![A-Za-z0-9])' END AS pattern, CASE page_id % 4 WHEN 0 THEN '1000_0' WHEN 1 THEN '$1master1200' ELSE 'large' END AS replacement,
    count(*) AS pairs, min(page_id) AS seq FROM pages WHERE page_id % 4 < 3 GROUP BY page_id % 4"""
)
def derive_rewrite_rules(spark, sf):
    return M.derive_rewrite_rules(_picture_pairs(_pages(spark, sf))).select("pattern", "replacement", "pairs", "seq")


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN stem || '/x.thumb.1000_0.jpeg' WHEN 1 THEN stem || '/img/' || page_id || '_p0_master1200.jpg'
      WHEN 2 THEN stem || '/large/i' || page_id || '.png' ELSE stem || '/same.gif' END AS original,
    CASE WHEN page_id % 4 < 3 THEN (SELECT min(q.page_id) FROM pages q WHERE q.page_id % 4 = p.page_id % 4) END AS rule_seq
    FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^?#]*'), '/$', '') AS stem FROM pages) p"""
)
def rewrite_urls(spark, sf):
    """Rules found in one table of pairs, applied to all small addresses without leaving Spark."""
    pairs = _picture_pairs(_pages(spark, sf))
    out = M.rewrite_urls(pairs.select(F.col("seq").alias("page_id"), "thumb"), cut(M.derive_rewrite_rules(pairs)), "thumb")
    return out.select("page_id", "original", "rule_seq")


@query(
    """SELECT page_id, CASE WHEN url LIKE '%#%' THEN 'fragment' ELSE 'none' END AS cut_kind, FALSE AS cut_changed,
    'cross-site' AS moved_kind, CASE WHEN regexp_matches(url, '://www\\.') THEN 'none' ELSE 'none' END AS www_kind, 'path' AS path_kind FROM pages"""
)
def url_changed(spark, sf):
    changed = lambda final: U.url_changed("url", final)
    base = F.regexp_replace("url", "#.*$", "")
    slash = F.when(F.col("url").contains("?"), base).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/")))
    d = _pages(spark, sf).select(
        "page_id", changed(base).alias("a"), changed(F.concat(F.lit("https://else.example.biz"), U.url_part("url", "path"))).alias("b"),
        U.url_changed(base, slash).alias("c"), U.url_changed(base, F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0), F.lit("/other/place"))).alias("d"),
    )
    return d.select("page_id", F.col("a.kind").alias("cut_kind"), F.col("a.changed").alias("cut_changed"), F.col("b.kind").alias("moved_kind"), F.col("c.kind").alias("www_kind"), F.col("d.kind").alias("path_kind"))


@query("SELECT page_id, url, 'demo' AS batch, regexp_replace(regexp_extract(url, '://([^/?#]+)', 1), ':\\d+$', '') AS source_domain FROM pages")
def enrich(spark, sf):
    return I.enrich(I.add_fields(_pages(spark, sf).select("page_id", "url"), {"batch": "demo", "url": "kept"}))


@query(
    """SELECT page_id, status, field_count, CASE WHEN status = 'parse_error' THEN '' ELSE 'li' END AS item_selector, CASE WHEN status = 'parse_error' THEN 0 ELSE 2 END AS n_steps FROM
    (SELECT page_id, CASE WHEN url LIKE '%#%' THEN 'parse_error' ELSE 'ok' END AS status, CASE WHEN url LIKE '%#%' THEN 0 ELSE 1 END AS field_count FROM pages)"""
)
def validate_rules(spark, sf):
    """Rule texts made from page addresses; those of pages with a fragment are cut off."""
    text = F.concat(
        F.lit('{"mode":"'), F.regexp_extract("url", "^[a-z]+", 0),
        F.lit('","list_rule":{"item_selector":" li ","fields":[{"name":"t","selector":"a","attribute":"null","transform":"strip, lower"},{"name":"","selector":"b"}]}'),
        F.when(F.col("url").contains("#"), "").otherwise("}"),
    )
    d = L.validate_rules(_pages(spark, sf).select("page_id", text.alias("rule_json")))
    ok = F.col("status") != "parse_error"
    return d.select(
        "page_id", "status", F.when(ok, F.col("field_count")).otherwise(0).alias("field_count"),
        F.when(ok, F.col("list_rule.item_selector")).otherwise("").alias("item_selector"),
        F.when(ok, F.size(F.get("list_rule.fields", F.lit(0))["transform"])).otherwise(0).alias("n_steps"),
    )

