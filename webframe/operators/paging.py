"""Finding the next page, and following it over a corpus of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webframe.functions.urls import resolve_url
from webframe.operators.structure import unique_selector
from webframe.plans.lineage import cut, release

# What "next" and "previous" look like, and page parameters of URLs.
NEXT_TEXT = r"(?i)(下一页|下页|后一页|次へ|次のページ|次ページ|もっと見る|続きを(見|読)む|next\s*page|^next$|older|›|»|>>|→)"
PREV_TEXT = r"(?i)(上一页|前一页|前一頁|前へ|prev|‹|«|←)"
CURRENT_CLASS = r"(?i)(^|[\s-])(active|current|selected|is-active)([\s-]|$)"
PAGE_PARAM = r"(?i)[?&](?:p|page|pg|pageno|pagenum)=(\d+)"
MAX_LABEL = 20
STRATEGIES = ("text", "rel-next", "numeric", "page-param")

NODE_COLUMNS = (
    "node_id", "parent_id", "depth", "tag", "elem_id", "classes", "attrs", "path", "anc_ids", "text", "hidden",
)


def _attr(name: str):
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def pagination(nodes: DataFrame, with_selector: bool = True) -> DataFrame:
    """One row per page that has a next link: strategy, target, text, address.

    Four strategies in order of trust: a "next" label, ``rel=next``, a numeric
    pager, a link whose page parameter is the current one plus one. ``nodes``
    carries the page ``url``.
    """
    links = nodes.where((F.col("tag") == "a")).select(
        "page_id", F.col("node_id").alias("a_id"), F.when(F.map_contains_key("attrs", "href"), _attr("href")).alias("a_href")
    )
    segs = F.split("path", "/")
    a_level = F.array_max(F.transform(segs, lambda s, i: F.when(s.rlike(r"^a[#.:]"), i)))
    near = F.when(a_level == F.col("depth"), F.col("node_id")).when(a_level.isNotNull(), F.get("anc_ids", a_level))
    role_button = _attr("role") == "button"
    label = F.col("tag").isin("a", "button") | role_button
    t = F.col("text")
    is_next = label & ~F.col("hidden") & (F.length(t) > 0) & (F.length(t) <= MAX_LABEL) & t.rlike(NEXT_TEXT) & ~t.rlike(PREV_TEXT)
    is_rel = F.col("tag").isin("a", "link") & (_attr("rel") == "next")
    number = t.rlike(r"^\d{1,4}$")
    is_num = number & ~F.col("hidden") & (F.col("tag").isin("button", "span", "li") | ((F.col("tag") == "a") & F.map_contains_key("attrs", "href")))
    here = F.coalesce(F.nullif(F.regexp_extract("url", PAGE_PARAM, 1), F.lit("")).try_cast("int"), F.lit(1))
    param = F.nullif(F.regexp_extract(_attr("href"), PAGE_PARAM, 1), F.lit("")).try_cast("int")
    is_param = (F.col("tag") == "a") & (param == here + 1)
    rows = nodes.where(is_next | is_rel | number | is_param).select(
        "page_id", "url", "node_id", "parent_id", "tag", "text", "attrs", "classes",
        near.alias("a_id"), is_next.alias("x1"), is_rel.alias("x2"), is_num.alias("x3"), number.alias("num"),
        F.coalesce(is_param, F.lit(False)).alias("x4"), here.alias("here"),
    )
    rows = rows.join(links, ["page_id", "a_id"], "left")
    href = F.coalesce("a_href", F.lit(""))
    found = lambda rank, target, text, link, cur: F.struct(
        F.lit(rank).alias("rank"), F.col("node_id").alias("at"), target.alias("node_id"), text.alias("next_text"),
        link.alias("next_href"), cur.cast("int").alias("current_page"),
    )
    none = F.lit(None)
    own = rows.where("x1 or x2 or x4").select(
        "page_id",
        F.explode(F.array_compact(F.array(
            F.when(F.col("x1"), found(1, F.when(href != "", F.col("a_id")).otherwise(F.col("node_id")), F.substring("text", 1, MAX_LABEL), href, none)),
            F.when(F.col("x2"), found(2, F.col("node_id"), F.substring("text", 1, MAX_LABEL), _attr("href"), none)),
            F.when(F.col("x4"), found(4, F.col("node_id"), F.when(F.col("text") == "", (F.col("here") + 1).cast("string")).otherwise(F.substring("text", 1, MAX_LABEL)), _attr("href"), F.col("here"))),
        ))).alias("f"),
    )
    sib = Window.partitionBy("page_id", "parent_id")
    nums = rows.where("num").withColumn("sibs", F.count("*").over(sib)).where(F.col("x3") & (F.col("sibs") >= 3))
    nums = nums.withColumn("n", F.col("text").try_cast("int")).withColumn(
        "current",
        _attr("aria-current").isin("true", "page") | F.array_join("classes", " ").rlike(CURRENT_CLASS) | F.col("a_id").isNull(),
    )
    state = nums.groupBy("page_id").agg(
        F.count("*").alias("c"),
        F.coalesce(F.min_by("n", F.when(F.col("current"), F.col("node_id"))), F.min_by("n", "node_id")).alias("cur"),
    ).where("c >= 3")
    ahead = nums.where(F.col("a_id").isNotNull() & (href != "")).join(state, "page_id").where(F.col("n") > F.col("cur"))
    order = F.struct((F.col("n") != F.col("cur") + 1).alias("far"), F.col("n").alias("n"), F.col("node_id").alias("id"))
    numeric = ahead.groupBy("page_id").agg(
        F.min_by(found(3, F.col("a_id"), F.col("n").cast("string"), href, F.col("cur")), order).alias("f")
    )
    best = own.unionByName(numeric).groupBy("page_id").agg(F.min_by("f", F.struct("f.rank", "f.at")).alias("f"))
    names = F.array(*[F.lit(s) for s in STRATEGIES])
    out = best.select(
        "page_id", F.element_at(names, F.col("f.rank")).alias("strategy"), F.col("f.node_id").alias("node_id"),
        F.col("f.next_text").alias("next_text"), F.col("f.next_href").alias("next_href"), F.col("f.current_page").alias("current_page"),
    )
    if not with_selector:
        return out
    sel = unique_selector(nodes, out.select("page_id", "node_id")).withColumnRenamed("selector", "next_selector")
    return out.join(sel, ["page_id", "node_id"], "left")


def next_edges(pages: DataFrame, paging: DataFrame) -> DataFrame:
    """``(page_id, next_url)`` with the address made absolute."""
    d = paging.where(F.col("next_href") != "").join(pages.select("page_id", "url"), "page_id")
    return d.select("page_id", F.regexp_replace(resolve_url("url", "next_href"), "#.*$", "").alias("next_url"))


def _links(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """``(page_id, to_id)``: the page that each page's next link leads to; links to itself and out of the corpus are none."""
    address = pages.select(F.col("page_id").alias("to_id"), F.regexp_replace("url", "#.*$", "").alias("next_url"))
    address = address.groupBy("next_url").agg(F.min("to_id").alias("to_id"))
    found = edges.join(address, "next_url").where(F.col("page_id") != F.col("to_id"))
    return found.groupBy("page_id").agg(F.min("to_id").alias("to_id"))


def _expand(starts: DataFrame, links: DataFrame, max_pages: int | None) -> DataFrame:
    """Pages of the chains from some starts: with links of 1, 2, 4, ... steps, so rounds grow with the logarithm of the longest."""
    reach = cut(starts.select(F.col("page_id").alias("start_id"), "page_id", F.lit(1).alias("step")))
    jump, width, known = links, 1, reach.count()
    while known and (max_pages is None or width < max_pages):
        more = reach.join(jump, "page_id").select("start_id", F.col("to_id").alias("page_id"), (F.col("step") + width).alias("step"))
        more = more if max_pages is None else more.where(F.col("step") <= max_pages)
        # a page that the chain has met before ends it: only its first step stays
        wider = cut(reach.unionByName(more).groupBy("start_id", "page_id").agg(F.min("step").alias("step")))
        now = wider.count()
        release(reach)
        reach = wider
        if now == known:
            break
        known = now
        onward = jump.select(F.col("page_id").alias("_via"), F.col("to_id").alias("_to"))
        jump = cut(jump.join(onward, F.col("to_id") == F.col("_via")).select("page_id", F.col("_to").alias("to_id")))
        width *= 2
    return reach


def _ring_starts(links: DataFrame) -> DataFrame:
    """The smallest page of every ring that no page outside leads into."""
    d = cut(links.select("page_id", "to_id", F.least("page_id", "to_id").alias("low")))
    while True:
        ahead = d.select(F.col("page_id").alias("_via"), F.col("to_id").alias("_to"), F.col("low").alias("_low"))
        wider = cut(d.join(ahead, F.col("to_id") == F.col("_via")).select(
            "page_id", F.col("_to").alias("to_id"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved")))
        if not wider.where("moved").limit(1).count():
            return wider.where(F.col("page_id") == F.col("low")).select("page_id")
        d = wider.drop("moved")


def page_chains(pages: DataFrame, edges: DataFrame, max_pages: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """``(start_id, step, page_id)`` of every chain of next links, first page at step 1.

    Chains start at pages that no link leads to, and at the smallest page of a ring,
    unless ``starts`` names others. A chain ends at a missing link, before a page it has
    met, or after ``max_pages``. ``edges``: page_id, next_url; of several links of a page
    the one to the smallest page counts.
    """
    links = cut(_links(pages, edges))
    if starts is not None:
        return _expand(starts.select("page_id").distinct(), links, max_pages).select("start_id", "step", "page_id")
    heads = pages.select("page_id").join(links.select(F.col("to_id").alias("page_id")), "page_id", "left_anti")
    chains = _expand(heads, links, max_pages)
    every = chains if max_pages is None else _expand(heads, links, None)
    rings = cut(links.join(every.select("page_id"), "page_id", "left_anti"))
    return chains.unionByName(_expand(_ring_starts(rings), rings, max_pages)).select("start_id", "step", "page_id")


def follow_pages(pages: DataFrame, edges: DataFrame, items: DataFrame, max_pages: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """Pages of every chain ``(start_id, step, page_id)`` as :func:`page_chains` finds them, up to the first without new items.

    A chain ends after a page whose items are all known in the chain
    (``no_new_rows``). ``items`` has ``page_id`` and ``content_hash``.
    """
    chain = cut(page_chains(pages, edges, max_pages, starts))
    first_seen = chain.join(items.select("page_id", "content_hash").distinct(), "page_id").groupBy("start_id", "content_hash").agg(F.min("step").alias("step"))
    fresh = first_seen.select("start_id", "step").distinct()
    dead = chain.where("step > 1").select("start_id", "step").join(fresh, ["start_id", "step"], "left_anti")
    stop = dead.groupBy("start_id").agg(F.min("step").alias("stop"))
    return chain.join(stop, "start_id", "left").where(F.col("stop").isNull() | (F.col("step") <= F.col("stop"))).select(
        "start_id", "step", "page_id", (F.col("step") == F.col("stop")).alias("no_new_rows")
    ).withColumn("no_new_rows", F.coalesce("no_new_rows", F.lit(False)))


def chain_items(chain: DataFrame, items: DataFrame) -> DataFrame:
    """Items of a chain in page order, each content once."""
    w = Window.partitionBy("start_id", "content_hash").orderBy("step", "item_id")
    d = chain.join(items, "page_id").withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return d.drop("_rn", "no_new_rows")
