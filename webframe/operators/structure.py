"""Discovery of repeated lists, their fields and selectors.

All steps work on element rows. Selectors that differ from page to page cannot
be compiled into the plan, so they are compared segment by segment with array
functions, each against the elements of its own page or item. All repeated
groups of a page are ranked, all fields and levels of an item looked at; callers
may ask for fewer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webframe.functions.common import col_of, let
from webframe.functions.matching import found, prepared
from webframe.operators import selectors as S
from webframe.plans.lineage import cut
from webframe.plans.ordering import dealt

# Element kinds, limits and attribute names used by discovery.
SKIP_TAGS = (
    "script", "style", "noscript", "template", "svg", "path", "link", "meta", "iframe", "canvas",
    "textarea", "input", "select", "option",
)
BUILT_CLASSES = ("css-", "sc-", "chakra-", "jsx-", "svelte-")
CONTAINER_TAGS = ("ul", "ol", "div", "section", "main", "article")
MIN_GROUP, MIN_TEXT = 3, 10
MAX_CLASSES, MAX_CLASS_LEN = 3, 40
MAX_CHAIN = 30
#: Forms of a field selector that are tried at each level.
MAX_FORMS = 6
LAZY_ATTRS = ("data-src", "data-original", "data-lazy-src", "data-actualsrc", "data-echo")
BACKGROUND_ATTRS = ("data-bg", "data-background", "data-bg-src", "data-background-image")
AUDIO_EXT = (".mp3", ".m4a", ".ogg", ".wav", ".flac")
VIDEO_EXT = (".mp4", ".webm")
PRICE_TEXT = r"^[¥$€£]|￥|\d{1,3}(,\d{3})*(\.\d+)?\s*元|\d+\.\d{2}\b"
SELF_NAMES = ("title", "link", "image", "audio", "video", "price", "thumb", "image_srcset", "text")
PRIMARY_NAMES = ("title", "name", "song_name", "image", "link", "url", "price", "artist", "user")
# What a column holds, by its link, text and surrounding class names.
SEMANTIC_RULES = (
    (r"/artist|/musician|/singer|artist|singer|歌手|艺术家|艺人|演唱|author|performer", "artist"),
    (r"/album|/disc|album|专辑|唱片", "album"),
    (r"/user|/uid|/member|/profile|/author|user|author|uploader|用户|作者|博主|up主", "user"),
    (r"^\d{1,2}:\d{2}(:\d{2})?$|song_?time|duration|时长|length", "duration"),
    (r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|song_?date|日期|发布时间|发布于|date|time", "date"),
    (r"play_?count|播放|收听|播放量|views?|播放次数", "play_count"),
    (r"comment_?count|评论|回复|comment|repl", "comment_count"),
    (r"\bsong_?name\b|歌名|歌曲名|曲名", "title"),
    (r"类型|分类|标签|category|genre|tag", "category"),
)
# Words in selectors that speak for data, or for navigation.
DATA_HINTS = (
    "article", "product", "card", "item", "post", "entry", "result",
    "thumb", "figure", "media", "video", "story", "list-item", "goods",
)
NAV_HINTS = (
    "nav", "footer", "aside", "header", "menu", "breadcrumb", "sidebar",
    "toolbar", "pagination", "pager", "tag-list", "social",
)
MIN_DATA_ITEMS, MIN_LINKS, MIN_IMAGES = 8, 20, 5

NODE_COLUMNS = (
    "node_id", "end_id", "parent_id", "depth", "nth_of_type", "type_count", "n_kids", "tag", "elem_id",
    "classes", "attrs", "path", "anc_ids", "own_text", "text", "text_len", "n_links", "n_imgs", "hidden",
)
LIST_COLUMNS = (
    "node_id", "end_id", "parent_id", "depth", "tag", "elem_id", "classes", "attrs", "path", "anc_ids",
    "text_len", "n_links", "n_imgs",
)


def stable_classes(classes) -> Column:
    """Class names without the ones that build tools generate."""
    # names too short to hold a digest meet no pattern
    built = lambda c: reduce(Column.__or__, [c.startswith(x) for x in BUILT_CLASSES])
    return F.filter(
        col_of(classes),
        lambda c: ~built(c) & ((F.length(c) < 10) | ~c.rlike(r"(?i)[a-f0-9]{10,}")) & (F.length(c) <= MAX_CLASS_LEN),
    )


def selector_classes(classes) -> Column:
    return F.slice(stable_classes(classes), 1, MAX_CLASSES)


def css_escape(c: Column) -> Column:
    """Names as they appear in a selector; a leading digit in six-digit form."""
    body = F.regexp_replace(c, r"([^\w\-\x{80}-\x{10ffff}])", r"\\$1")
    return F.when(c.rlike(r"^\d"), F.concat(F.lit("\\00003"), body)).otherwise(body)


def _dotted(classes: Column) -> Column:
    return F.concat_ws("", F.transform(classes, lambda c: F.concat(F.lit("."), css_escape(c))))


def by_page(df: DataFrame) -> DataFrame:
    """Rows dealt out by page, and never broadcast.

    Element tables compress fifty-fold, so their files say little about the memory that
    a broadcast of them takes. Grouping and joining within pages needs no further shuffle.
    """
    return dealt(df, "page_id").hint("merge")


# ---- path segments -----------------------------------------------------------

def _segment(s: Column, classes: bool = True) -> Column:
    first = lambda s, sep: F.substring_index(s, sep, 1)
    head = first(s, ":")
    parts = [
        first(first(head, "."), "#").alias("tag"),
        F.when(head.contains("#"), first(F.substring_index(head, "#", -1), ".")).otherwise("").alias("id"),
        F.replace(F.substring_index(s, ":", -1), F.lit("!"), F.lit("")).alias("nth"),
        s.endswith("!").alias("only"),
    ]
    if classes:
        parts.append(F.slice(F.split(head, r"\."), F.lit(2), F.length(s)).alias("cls"))
    return F.struct(*parts)


def _segments(path: Column, classes: bool = True) -> Column:
    """Segments from the node upwards as ``struct(tag, id, nth, only[, cls])``."""
    return F.transform(F.reverse(F.split(path, "/")), lambda s: _segment(s, classes))


def _bare(path: Column) -> Column:
    """The path without ids and positions: tag and classes of every segment."""
    bare = F.regexp_replace(path, r":[^/]*", "")
    return F.when(path.contains("#"), F.regexp_replace(bare, r"((?:^|/)[^/.#]*)#[^/.]*", "$1")).otherwise(bare)


def _names(path: Column) -> Column:
    """Segments from the node upwards as ``[tag, class, ..]``."""
    return F.transform(F.reverse(F.split(_bare(path), "/")), lambda s: F.split(s, r"\."))


def _path_tokens(path: Column) -> Column:
    """Segments from the node upwards as ``[tag, .class, ..]``; names in a path hold no spaces."""
    return F.transform(F.reverse(F.split(F.replace(_bare(path), F.lit("."), F.lit(" .")), "/")), lambda s: F.split(s, " "))


def _decode(c: Column) -> Column:
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def unique_selector(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``(page_id, node_id, selector)`` matching exactly that element of its page.

    id, then one data attribute, then tag with classes, then the shortest chain
    of direct children. A target is compared with the elements of its own tag
    on its own page; one aggregate gives, over all other elements, the longest
    chain they share with it, and one more segment is what tells them apart.
    """
    data = F.filter(
        F.map_entries("attrs"), lambda e: e["key"].startswith("data-") & (e["value"] != "") & (e["key"] != "data-v")
    )
    chain = F.transform(
        F.filter(_segments(F.col("path"), False), lambda s: ~s["tag"].isin("html", "body")),
        lambda s, i: F.struct(
            s["tag"].alias("tag"), s["id"].alias("id"),
            F.when(s["only"], "").otherwise(s["nth"]).alias("nth"), (i == 0).alias("self"),
        ),
    )
    nodes = by_page(nodes)
    t = by_page(targets.select("page_id", "node_id").distinct()).join(nodes, ["page_id", "node_id"]).select(
        "page_id", F.col("node_id").alias("t_id"), "tag", F.col("elem_id").alias("t_elem"),
        selector_classes("classes").alias("t_cls"), data.alias("t_data"), chain.alias("t_chain"),
    )
    t = by_page(cut(t))
    # only elements that share a tag with a target of their page are taken apart
    like = nodes.join(t.select("page_id", "tag").distinct(), ["page_id", "tag"], "left_semi")
    m = like.select("page_id", "node_id", "tag", "classes", "attrs", F.reverse(F.split("path", "/")).alias("segs"))
    pairs = t.join(m, ["page_id", "tag"]).where(F.col("node_id") != F.col("t_id"))

    def same(tc: Column, ms: Column) -> Column:
        by_tag = (tc["tag"] == ms["tag"]) & ((tc["nth"] == "") | (tc["nth"] == ms["nth"]))
        return F.when(tc["id"] != "", (tc["id"] == ms["id"]) & (~tc["self"] | (tc["tag"] == ms["tag"]))).otherwise(by_tag)

    def strict(tc: Column, ms: Column) -> Column:
        return (tc["tag"] == ms["tag"]) & ((tc["nth"] == "") | (tc["nth"] == ms["nth"]))

    n = F.least(F.size("t_chain"), F.size("segs"))
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    # segments are taken apart only as far as they agree
    def further(k: Column, i: Column) -> Column:
        t = F.get("t_chain", i)
        both = let(_segment(F.get("segs", i), False), lambda s: F.struct(
            F.when((k["same"] == i) & same(t, s), i + 1).otherwise(k["same"]).alias("same"),
            F.when((k["strict"] == i) & strict(t, s), i + 1).otherwise(k["strict"]).alias("strict")))
        return F.when((k["same"] == i) | (k["strict"] == i), both).otherwise(k)

    shared = F.aggregate(steps, F.struct(F.lit(0).alias("same"), F.lit(0).alias("strict")), further)
    clash = F.aggregate(
        F.transform("t_data", lambda e, i: F.when(F.try_element_at("attrs", e["key"]) == e["value"], F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0)),
        F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x),
    )
    worst = pairs.withColumn("shared", shared).groupBy("page_id", "t_id").agg(
        F.max("shared.same").alias("shared"),
        F.max("shared.strict").alias("shared_strict"),
        F.bit_or(clash).alias("clash"),
        F.max(F.size(F.array_except("t_cls", "classes")) == 0).alias("cls_clash"),
    )
    ids = nodes.where(F.col("elem_id").isNotNull()).groupBy("page_id", F.col("elem_id").alias("t_elem")).agg(F.count("*").alias("id_n"))
    d = t.join(worst, ["page_id", "t_id"], "left").join(ids, ["page_id", "t_elem"], "left")
    good_data = F.get(
        F.filter(
            F.transform(
                "t_data",
                lambda e, i: F.when(
                    F.coalesce(F.col("clash"), F.lit(0).cast("long")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) == 0,
                    F.concat(F.col("tag"), F.lit("["), e["key"], F.lit('="'), F.replace(e["value"], F.lit('"'), F.lit('\\"')), F.lit('"]')),
                ),
            ),
            lambda s: s.isNotNull(),
        ),
        F.lit(0),
    )
    seg_text = lambda s: F.when(
        s["id"] != "", F.concat(F.when(s["self"], s["tag"]).otherwise(""), F.lit("#"), css_escape(_decode(s["id"])))
    ).otherwise(F.concat(s["tag"], F.when(s["nth"] != "", F.concat(F.lit(":nth-of-type("), s["nth"], F.lit(")"))).otherwise("")))
    strict_text = lambda s: F.concat(s["tag"], F.when(s["nth"] != "", F.concat(F.lit(":nth-of-type("), s["nth"], F.lit(")"))).otherwise(""))
    need, need_strict = (F.coalesce(F.col(c), F.lit(0)).cast("int") + 1 for c in ("shared", "shared_strict"))
    size = F.size("t_chain")
    part = lambda k, text: F.array_join(F.reverse(F.transform(F.slice("t_chain", F.lit(1), F.least(k, size)), text)), " > ")
    # repeated ids can make the id chain ambiguous; positions below body never are
    by_chain = (
        F.when(need <= size, part(need, seg_text))
        .when(need_strict <= size, part(need_strict, strict_text))
        .otherwise(F.concat(F.lit("body > "), part(size, strict_text)))
    )
    selector = (
        F.when(F.col("tag").isin("body", "html"), F.col("tag"))
        .when(F.col("id_n") == 1, F.concat(F.lit("#"), css_escape(F.col("t_elem"))))
        .when(good_data.isNotNull(), good_data)
        .when((F.size("t_cls") > 0) & ~F.coalesce("cls_clash", F.lit(False)), F.concat("tag", _dotted(F.col("t_cls"))))
        .otherwise(by_chain)
    )
    return d.select("page_id", F.col("t_id").alias("node_id"), selector.alias("selector"))


# ---- lists -------------------------------------------------------------------

def _parent_tag() -> Column:
    return F.regexp_extract("path", r"(?:^|/)([^/#.:]+)[^/]*/[^/]*$", 1)


def _groups(nodes: DataFrame) -> DataFrame:
    """Groups of at least three like children per parent, over all parents."""
    own_link = ((F.col("tag") == "a") & F.map_contains_key("attrs", "href")).cast("int")
    own_img = ((F.col("tag") == "img") & F.map_contains_key("attrs", "src")).cast("int")
    useful = (
        (F.col("parent_id") >= 0) & ~F.col("tag").isin(*SKIP_TAGS)
        & ((F.col("text_len") > MIN_TEXT) | (F.col("n_links") - own_link + F.col("n_imgs") - own_img > 0))
    )
    up = _parent_tag()
    listed = up.isin(*CONTAINER_TAGS) | ((up == "tbody") & F.col("path").rlike(r"(^|/)table[#.:]"))
    child = nodes.where(useful).select(
        "page_id", F.col("parent_id").alias("container_id"), "tag", "node_id", listed.alias("listed"), stable_classes("classes").alias("cls"),
    )
    # counted by classes as written first: only few of these rows meet the sort that orders arrays
    alike = child.groupBy("page_id", "container_id", "tag", "cls").agg(
        F.count("*").alias("members"), F.min("node_id").alias("first_id"), F.first("listed").alias("listed")
    )
    return alike.groupBy("page_id", "container_id", "tag", F.array_sort("cls").alias("sig")).agg(
        F.sum("members").alias("members"), F.min(F.struct("first_id", "cls")).alias("_f"), F.first("listed").alias("listed"),
    ).where(F.col("members") >= MIN_GROUP).select("page_id", "container_id", "tag", "sig", "members", "_f.first_id", "_f.cls", "listed")


def scope_region(nodes: DataFrame, selector: str) -> DataFrame:
    """First element per page matching the scope selector, with what discovery needs of it."""
    hit = S.select_nodes(nodes, selector).where(~F.col("tag").isin("html", "body"))
    first = hit.groupBy("page_id").agg(
        F.min_by(F.struct("node_id", "end_id", "parent_id", "tag", "text_len", F.array_sort(stable_classes("classes")).alias("sig"),
                          F.try_element_at("anc_ids", F.lit(-2)).alias("grand_id"), 
                          F.regexp_extract("path", r"([^/#.:]+)[^/]*/[^/]*/[^/]*$", 1).alias("grand_tag"),
                          _parent_tag().alias("parent_tag")), "node_id").alias("r")
    ).select("page_id", "r.*")
    kids = nodes.select("page_id", F.col("parent_id").alias("p2"), F.col("tag").alias("t2"), F.array_sort(stable_classes("classes")).alias("s2"))
    like = first.join(kids, (first["page_id"] == kids["page_id"]) & (first["parent_id"] == kids["p2"]) & (first["tag"] == kids["t2"])).where(
        F.col("sig") == F.col("s2")
    ).groupBy(first["page_id"]).agg(F.count("*").alias("like_n")).hint("merge")
    return first.join(like, "page_id", "left")


def list_candidates(
    nodes: DataFrame, scope: str | None = None, with_selectors: bool = True, merge: bool = False, limit: int | None = None
) -> DataFrame:
    """Repeated structures of every page, biggest first; all of them, or the ``limit`` biggest.

    ``scope`` restricts discovery to a region: lists inside it, else the region
    itself as a list, else (only when it is one of three like siblings) the
    list it belongs to, at most two levels up; pages without the region are
    searched whole.
    """
    nodes = by_page(nodes)
    groups = _groups(nodes)
    if scope:
        region = scope_region(nodes, scope).hint("merge")
        g = groups.join(region.select("page_id", *[F.col(c).alias(f"r_{c}") for c in region.columns if c != "page_id"]), "page_id", "left")
        inside = F.col("listed") & (F.col("container_id") > F.col("r_node_id")) & (F.col("container_id") <= F.col("r_end_id"))
        sib = F.coalesce(F.col("r_like_n"), F.lit(0)) >= MIN_GROUP
        level = (
            F.when(F.col("r_node_id").isNull(), F.when(F.col("listed"), 0))
            .when(inside, 0)
            .when(F.col("container_id") == F.col("r_node_id"), 1)
            .when(sib & (F.col("container_id") == F.col("r_parent_id")) & (F.col("r_parent_tag") != "body"), 2)
            .when(sib & (F.col("container_id") == F.col("r_grand_id")) & (F.col("r_grand_tag") != "body"), 3)
        )
        g = g.withColumn("level", level).where(F.col("level").isNotNull())
        best = g.groupBy("page_id").agg(F.min("level").alias("_lv")).hint("merge")
        g = g.join(best, "page_id").where(F.col("level") == F.col("_lv"))
        groups = g.select(*groups.columns, "level")
    else:
        groups = groups.where("listed").withColumn("level", F.lit(0))
    w = Window.partitionBy("page_id").orderBy("container_id", "first_id")
    top = by_page(cut(groups.drop("sig").withColumn("pos", F.row_number().over(w))))
    kids = nodes.where(F.col("parent_id") >= 0).groupBy("page_id", F.col("parent_id").alias("container_id"), "tag", F.col("classes").alias("have")).agg(F.count("*").alias("n"))
    counts = top.join(kids, ["page_id", "container_id", "tag"]).where(F.size(F.array_except("cls", "have")) == 0).groupBy("page_id", "pos").agg(F.sum("n").alias("count"))
    cands = top.join(counts, ["page_id", "pos"]).drop("listed")
    if scope:
        alone = Window.partitionBy("page_id").orderBy(F.desc("count"), "pos")
        cands = cands.withColumn("_a", F.row_number().over(alone)).where((F.col("level") == 0) | (F.col("_a") == 1)).drop("_a")
    cands = cands.drop("level")
    if limit is not None and not merge:  # the biggest are known before selectors are made
        cands = _ranked(cands, limit, keep_pos=True).drop("rank")
    if not with_selectors:
        return _ranked(cands, limit)
    cands = by_page(cut(cands))
    sel = unique_selector(nodes, cands.select("page_id", F.col("container_id").alias("node_id"))).withColumnsRenamed(
        {"node_id": "container_id", "selector": "container_selector"}
    )
    out = cands.join(sel, ["page_id", "container_id"]).withColumn(
        "item_selector", F.concat("container_selector", F.lit(" > "), "tag", _dotted(F.col("cls")))
    )
    return _ranked(merge_split_groups(cut(out), nodes) if merge else out, limit)


def _ranked(cands: DataFrame, limit: int | None = None, keep_pos: bool = False) -> DataFrame:
    """Position per page by count, ties by place in the page."""
    w = Window.partitionBy("page_id").orderBy(F.desc("count"), "pos")
    d = cands.withColumn("rank", F.row_number().over(w))
    d = d if limit is None else d.where(F.col("rank") <= limit)
    return d if keep_pos else d.drop("pos")


def merge_split_groups(cands: DataFrame, nodes: DataFrame) -> DataFrame:
    """Groups of one container that a wider selector covers exactly become one list."""
    cands, nodes = by_page(cands), by_page(nodes)
    g = cands.groupBy("page_id", "container_id").agg(
        F.count("*").alias("groups"), F.sum("count").alias("union_n"), F.max("count").alias("lead_n"),
        F.max_by("tag", F.struct("count", (-F.col("pos")).alias("p"))).alias("lead_tag"),
        F.collect_list("cls").alias("all_cls"), F.min("first_id").alias("min_first"), F.min("pos").alias("min_pos"),
    ).where((F.col("groups") > 1) & (F.col("union_n") > F.col("lead_n")))
    shared = F.aggregate(F.slice("all_cls", F.lit(2), F.size("all_cls")), F.get("all_cls", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    g = g.withColumn("shared", shared)
    tag_n = nodes.groupBy("page_id", F.col("parent_id").alias("container_id"), F.col("tag").alias("lead_tag")).agg(F.count("*").alias("tag_n"))
    cls_n = nodes.select("page_id", F.col("tag").alias("lead_tag"), F.explode("classes").alias("c")).groupBy("page_id", "lead_tag", "c").agg(F.count("*").alias("cls_n"))
    by_cls = g.select("page_id", "container_id", "lead_tag", "union_n", F.posexplode("shared").alias("i", "c")).join(cls_n, ["page_id", "lead_tag", "c"]).where(
        F.col("cls_n") == F.col("union_n")
    ).groupBy("page_id", "container_id").agg(F.min_by("c", "i").alias("wide_cls")).hint("merge")
    m = g.join(tag_n, ["page_id", "container_id", "lead_tag"]).join(by_cls, ["page_id", "container_id"], "left")
    m = m.withColumn("by_tag", F.col("tag_n") == F.col("union_n")).where(F.col("by_tag") | F.col("wide_cls").isNotNull())
    m = m.select("page_id", "container_id", "union_n", "lead_tag", "by_tag", "wide_cls", "min_first", "min_pos")
    both = cands.join(m, ["page_id", "container_id"], "left")
    kept = both.where(F.col("union_n").isNull()).select(*cands.columns)
    merged = both.where(F.col("union_n").isNotNull() & (F.col("pos") == F.col("min_pos"))).select(
        *[
            {
                "count": F.col("union_n").alias("count"),
                "tag": F.col("lead_tag").alias("tag"),
                "first_id": F.col("min_first").alias("first_id"),
                "cls": F.when(F.col("by_tag"), F.array().cast("array<string>")).otherwise(F.array("wide_cls")).alias("cls"),
                "item_selector": F.when(F.col("by_tag"), F.concat("container_selector", F.lit(" > "), "lead_tag"))
                .otherwise(F.concat("lead_tag", F.lit("."), css_escape(F.col("wide_cls")))).alias("item_selector"),
            }.get(c, F.col(c))
            for c in cands.columns
        ]
    )
    return kept.unionByName(merged)


# ---- fields ------------------------------------------------------------------

def semantic_name(href, text, context, fallback) -> Column:
    """Readable column name by the ordered rules, else *fallback*."""
    probe = F.lower(F.concat_ws(" ", F.coalesce(col_of(href), F.lit("")), F.coalesce(col_of(text), F.lit("")), F.coalesce(col_of(context), F.lit(""))))

    def pick(s: Column) -> Column:
        out = F.when(found(s, SEMANTIC_RULES[0][0], "(?i)"), SEMANTIC_RULES[0][1])
        for pattern, name in SEMANTIC_RULES[1:]:
            hit = found(s, pattern, "(?i)")
            if name == "duration":  # a bare clock time is meant to match by the text alone
                hit = hit | F.coalesce(F.trim(col_of(text)).rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), F.lit(False))
            out = out.when(hit, name)
        return out

    return F.coalesce(let(prepared(probe), pick), col_of(fallback))


def looks_generated(name) -> Column:
    """Field names that are build artefacts, as discovery judges them."""
    n = col_of(name)
    return ~n.isin(*SELF_NAMES) & (
        n.rlike(r"(?i)^[a-z]{1,3}-?[a-z]{0,4}\d{1,3}$")
        | n.rlike(r"(?i)^(css|sc|jsx|emotion|styled)-")
        | ((F.length(n) >= 6) & n.rlike(r"^[a-z]+[A-Z]"))
    )


def looks_generated_name(name) -> Column:
    """The stricter judgement on rule fields: bare tag names count too, '_' equals '-'."""
    n = F.translate(F.trim(col_of(name)), "_", "-")
    return F.coalesce(n != "", F.lit(False)) & n.rlike(
        r"^(?:[a-z]{1,3}-?[a-z]{0,4}\d{1,3}|(?:css|sc|jsx|emotion|styled)-.*|[a-z]{2,}[A-Z][a-zA-Z]{2,}"
        r"|td|th|tr|span|div|li|em|b|i|p)$"
    )


def drop_redundant_fields(fields: DataFrame, group: tuple[str, ...] = ("page_id", "rank")) -> DataFrame:
    """Drop a generated name when the same selector and attribute has a readable one."""
    w = Window.partitionBy(*group, "selector", F.coalesce("attribute", F.lit("")))
    d = fields.withColumn("_gen", looks_generated("name")).withColumn("_ok", F.max((~F.col("_gen")).cast("int")).over(w))
    return d.where(~F.col("_gen") | (F.col("_ok") == 0)).drop("_gen", "_ok")


def drop_generated_fields(fields: DataFrame, group: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Drop generated names of a rule unless nothing would be left."""
    w = Window.partitionBy(*group)
    d = fields.withColumn("_gen", looks_generated_name("name")).withColumn("_left", F.count_if(~F.col("_gen")).over(w))
    return d.where(~F.col("_gen") | (F.col("_left") == 0)).drop("_gen", "_left")


def _relative_chain(path: Column, levels: Column) -> Column:
    """Segments from the element up to below its item: tag and first stable classes."""
    return F.transform(
        F.slice(_names(path), F.lit(1), levels),
        lambda s: F.concat(
            F.slice(s, 1, 1), F.transform(selector_classes(F.slice(s, F.lit(2), F.size(s))), lambda c: F.concat(F.lit("."), c)),
        ),
    )


def _chain_text(chain: Column) -> Column:
    one = lambda t: F.concat_ws(
        "", F.transform(t, lambda x: F.when(x.startswith("."), F.concat(F.lit("."), css_escape(_decode(F.substring(x, F.lit(2), F.length(x)))))).otherwise(x))
    )
    return F.array_join(F.reverse(F.transform(chain, one)), " ")


def _matched_length(chain: Column, toks: Column) -> Column:
    """How many segments of a descendant chain an element satisfies (0: not even itself).

    ``toks`` are the element's segments from itself upwards; matching the
    nearest possible ancestor each time is exact for descendant chains.
    """
    first = F.size(F.array_except(F.get(chain, F.lit(0)), F.get(toks, F.lit(0)))) == 0
    climb = F.aggregate(
        F.slice(toks, F.lit(2), F.size(toks)), F.lit(1),
        lambda k, seg: F.when((k < F.size(chain)) & (F.size(F.array_except(F.get(chain, k), seg)) == 0), k + 1).otherwise(k),
    )
    return F.when(first, climb).otherwise(0)


def item_nodes(nodes: DataFrame, items: DataFrame, keys: tuple[str, ...] = ("rank",)) -> DataFrame:
    """Elements inside given items: equi-join of exploded ancestor ids with item ids."""
    low = nodes.withColumn("item_id", F.explode("anc_ids"))
    return low.join(items.select("page_id", "item_id", *keys), ["page_id", "item_id"])


def relative_selector(targets: DataFrame, inside: DataFrame, keys: tuple[str, ...] = ("page_id", "rank")) -> DataFrame:
    """Shortest class path of each target that is unique inside its item, else the longest.

    ``targets``: keys, ``node_id``, ``path``, ``depth`` and the ``item_depth``;
    ``inside``: all elements of the same items.
    """
    t = targets.select(*keys, F.col("node_id").alias("t_id"), _relative_chain(F.col("path"), F.col("depth") - F.col("item_depth")).alias("chain")).distinct()
    m = inside.select(*keys, "node_id", _path_tokens(F.col("path")).alias("toks"))
    worst = t.join(m, list(keys)).where(F.col("node_id") != F.col("t_id")).groupBy(*keys, "t_id").agg(
        F.max(_matched_length(F.col("chain"), F.col("toks"))).alias("n")
    )
    d = t.join(worst, [*keys, "t_id"], "left")
    length = F.least(F.coalesce("n", F.lit(0)) + 1, F.size("chain"))
    return d.select(*keys, F.col("t_id").alias("node_id"), _chain_text(F.slice("chain", F.lit(1), length)).alias("selector"))


def _attr(name: str) -> Column:
    return F.trim(F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit("")))


def _field(stage: int, k: int, name, attribute) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    attribute = F.lit(attribute).cast("string") if not isinstance(attribute, Column) else attribute
    return F.struct(F.lit(stage).alias("stage"), F.lit(k).alias("k"), name.alias("name"), attribute.alias("attribute"))


def infer_fields(cands: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Fields of every candidate, read off its first item; all of them, or the first ``limit``.

    Image, background, audio, video, first link (title, link, both), price
    leaves, then the other short leaf texts; each with a relative selector and,
    where the content tells, a readable name.
    """
    keys = ("page_id", "rank")
    items = cands.select("page_id", "rank", F.col("first_id").alias("item_id"))
    inside = cut(
        item_nodes(nodes, items).withColumn("item_depth", F.array_position("anc_ids", F.col("item_id")).cast("int") - 1)
    )
    w = Window.partitionBy(*keys)
    first = lambda test: F.min(F.when(test, F.col("node_id"))).over(w)
    ends = lambda exts: reduce(Column.__or__, [F.lower(_attr("href")).endswith(e) for e in exts])
    tag = F.col("tag")
    has_src = F.map_contains_key("attrs", "src")
    is_link = (tag == "a") & F.map_contains_key("attrs", "href")
    source_of = lambda kind: (tag == "source") & F.col("path").rlike(rf"/{kind}[#.:][^/]*/(?:[^/]+/)*source[#.:]")
    audio = (((tag == "audio") | source_of("audio")) & has_src) | (is_link & ends(AUDIO_EXT))
    video = (((tag == "video") | source_of("video")) & has_src) | (is_link & ends(VIDEO_EXT))
    firsts = {
        "f_img": first(tag == "img"),
        **{f"f_bg{i}": first(F.map_contains_key("attrs", a)) for i, a in enumerate(BACKGROUND_ATTRS)},
        "f_style": first(_attr("style").rlike(r"(?i)background(-image)?\s*:\s*url\(")),
        "f_audio": first(audio), "f_video": first(video), "f_link": first(is_link),
    }
    d = inside.withColumns(firsts)
    bg_ok = {
        f"bg{i}": F.max((F.col("node_id") == F.col(f"f_bg{i}")) & (_attr(a) != "")).over(w) for i, a in enumerate(BACKGROUND_ATTRS)
    }
    d = d.withColumns(bg_ok)
    me = F.col("node_id")
    lazy = F.coalesce(*[F.when(_attr(a) != "", F.lit(a)) for a in LAZY_ATTRS])
    no_img = F.col("f_img").isNull()
    bg_used = F.lit(False)
    out = [
        F.when((me == F.col("f_img")) & lazy.isNotNull(), _field(1, 0, "image", lazy)),
        F.when((me == F.col("f_img")) & lazy.isNotNull(), _field(1, 1, "thumb", "src")),
        F.when((me == F.col("f_img")) & lazy.isNull() & (_attr("src") != ""), _field(1, 0, "image", "src")),
        F.when((me == F.col("f_img")) & lazy.isNull() & (_attr("srcset") != ""), _field(1, 2, "image_srcset", "srcset")),
    ]
    for i, a in enumerate(BACKGROUND_ATTRS):
        ok = F.coalesce(F.col(f"bg{i}"), F.lit(False))
        out.append(F.when(no_img & ~bg_used & ok & (me == F.col(f"f_bg{i}")), _field(1, 3, "image", a)))
        bg_used = bg_used | ok
    out.append(F.when(no_img & ~bg_used & (me == F.col("f_style")), _field(1, 4, "image", "style")))
    by = lambda: F.when(_attr("href") != "", "href").otherwise("src")
    out.append(F.when(me == F.col("f_audio"), _field(2, 0, "audio", by())))
    out.append(F.when(me == F.col("f_video"), _field(3, 0, "video", by())))
    leaf = F.col("n_kids") == 0
    n = F.length("text")
    out += [
        F.when((me == F.col("f_link")) & (F.col("text") != ""), _field(4, 0, "?title", None)),
        F.when(me == F.col("f_link"), _field(4, 1, "link", "href")),
        F.when((me == F.col("f_link")) & (F.col("text") != ""), _field(4, 2, "link_text", "text_with_href")),
        F.when(leaf & (n > 0) & (n <= 60) & F.col("text").rlike(PRICE_TEXT), _field(5, 0, "price", None)),
        F.when(leaf & (n >= 2) & (n <= 60), _field(6, 0, "?leaf", None)),
    ]
    raw = d.withColumn("f", F.explode(F.array_compact(F.array(*out))))
    # leaves move up to a locatable parent that only wraps them (at most three levels)
    wraps = inside.where(
        (F.col("n_kids") == 1) & (F.col("own_text") == "")
        & ((F.size(stable_classes("classes")) > 0) | F.col("elem_id").isNotNull() | F.map_contains_key("attrs", "title"))
    ).select(*keys, F.col("node_id").alias("u_id"))
    ups = raw.where(F.col("f.name") == "?leaf").select(
        *keys, "node_id",
        F.posexplode(F.slice(F.reverse(F.slice("anc_ids", F.col("item_depth") + 2, F.size("anc_ids"))), 1, 3)).alias("lv", "u_id"),
    ).join(wraps, [*keys, "u_id"]).groupBy(*keys, "node_id").agg(F.sum(F.expr("shiftleft(1, lv)")).alias("mask"))
    climb = F.when(F.col("mask").bitwiseAND(1) == 0, 0).when(F.col("mask").bitwiseAND(2) == 0, 1).when(F.col("mask").bitwiseAND(4) == 0, 2).otherwise(3)
    raw = raw.join(ups, [*keys, "node_id"], "left").withColumn(
        "climb", F.when(F.col("f.name") == "?leaf", F.coalesce(F.when(F.col("mask").isNotNull(), climb), F.lit(0))).otherwise(0)
    )
    up_path = F.call_function("substring_index", F.col("path"), F.lit("/"), F.col("depth") + 1 - F.col("climb"))
    raw = raw.select(
        *keys, "item_depth", "f.*", F.col("node_id").alias("src_id"), "text",
        F.when(F.col("climb") == 0, F.col("node_id")).otherwise(F.element_at("anc_ids", -F.greatest(F.col("climb"), F.lit(1)))).alias("node_id"),
        up_path.alias("path"), (F.col("depth") - F.col("climb")).alias("depth"), "anc_ids",
        F.concat_ws(" ", _attr("name")).alias("own_name"),
    )
    segs = F.transform(F.slice(F.reverse(F.split("path", "/")), 1, 4), lambda s: _segment(s))
    a_pos = F.array_position(F.transform(_names(F.col("path")), lambda s: F.get(s, F.lit(0))), "a")
    link_id = F.when(a_pos == 1, F.col("node_id")).when(a_pos > 1, F.get("anc_ids", F.col("depth") - a_pos.cast("int") + 1))
    around = F.concat_ws(
        " ", F.flatten(F.transform(segs, lambda s: F.concat(s["cls"], F.array(s["id"])))), F.col("own_name")
    )
    links = nodes.where((F.col("tag") == "a") & F.map_contains_key("attrs", "href")).select(
        "page_id", F.col("node_id").alias("link_id"), F.try_element_at("attrs", F.lit("href")).alias("href")
    )
    raw = raw.withColumn("context", around).withColumn("link_id", link_id).join(links, ["page_id", "link_id"], "left")
    seg0 = F.get(segs, F.lit(0))
    cls0 = F.get(stable_classes(seg0["cls"]), F.lit(0))
    base = F.when(F.col("name") == "?title", "title").otherwise(
        F.coalesce(_decode(cls0), F.when(seg0["tag"] == "a", "text").otherwise(seg0["tag"]))
    )
    raw = raw.withColumn(
        "name", F.when(F.col("name").startswith("?"), semantic_name("href", "text", "context", base)).otherwise(F.col("name"))
    )
    raw = cut(raw.drop("anc_ids", "own_name"))
    sel = relative_selector(raw, inside, keys)
    d = raw.join(sel, [*keys, "node_id"])
    place = F.struct("stage", "src_id", "k")
    once = Window.partitionBy(*keys, "selector", F.coalesce("attribute", F.lit(""))).orderBy(place)
    d = d.withColumn("_o", F.row_number().over(once)).where("_o = 1")
    d = d.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(place)))
    d = d if limit is None else d.where(F.col("pos") <= limit)
    return d.select(*keys, "pos", "name", "selector", "attribute", "node_id")


def list_rows(cands: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """All rows of each candidate: children of its container with its tag and classes (and ``more`` of their columns)."""
    c = cands.select("page_id", "rank", "container_id", "tag", "cls")
    kids = nodes.select("page_id", F.col("parent_id").alias("container_id"), "tag", "classes", F.col("node_id").alias("item_id"), *more)
    return c.join(kids, ["page_id", "container_id", "tag"]).where(F.size(F.array_except("cls", "classes")) == 0).select("page_id", "rank", "item_id", *more)


def fix_field_coverage(fields: DataFrame, cands: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replace a field selector that misses some rows by the first that hits every row once.

    Fields that cover all rows are untouched. Candidates are forms of the
    sampled element: its classes or last class, with its own tag, with the tags
    seen in that place, or with none, as direct-child paths and anywhere.
    """
    keys = ["page_id", "rank"]
    source, fields, cands, nodes = fields.columns, by_page(fields), by_page(cands), by_page(nodes)
    rows = by_page(cut(list_rows(cands, nodes, "depth").withColumnRenamed("depth", "item_depth")))
    # an element has one ancestor at each depth, so only depths at which its page has rows are looked at
    depths = rows.groupBy("page_id").agg(F.collect_set("item_depth").alias("depths"))
    low = nodes.join(depths.hint("merge"), "page_id").select(
        "page_id", "node_id", "tag", "classes", "depth", "path", F.explode(F.filter("depths", lambda d: d < F.col("depth"))).alias("item_depth"), "anc_ids")
    low = low.withColumn("item_id", F.get("anc_ids", F.col("item_depth"))).drop("anc_ids")
    inside = low.join(rows.drop("item_depth"), ["page_id", "item_id"])
    pool = rows.groupBy(*keys).agg(F.count("*").alias("pool"))
    inside = by_page(cut(inside.select(*keys, "item_id", "node_id", "tag", "classes", "depth", "item_depth", _path_tokens(F.col("path")).alias("toks"))))
    m = inside.select(*keys, "item_id", "node_id", "depth", "item_depth", "toks")
    chain = F.transform(F.reverse(F.split("selector", " ")), lambda s: F.concat(
        F.array(F.regexp_extract(s, r"^([^.]+)", 1)), F.regexp_extract_all(s, F.lit(r"(\.(?:\\.|[^.])+)"), 1)))
    f = fields.withColumn("chain", chain)
    # an element that a selector ends at has its last tag
    ends = f.select(*keys, "pos", "chain", F.get(F.get("chain", F.lit(0)), F.lit(0)).alias("own_tag"))
    met = m.select(*keys, "item_id", "toks", F.get(F.get("toks", F.lit(0)), F.lit(0)).alias("own_tag"))
    hit = ends.join(met, [*keys, "own_tag"]).where(_matched_length(F.col("chain"), F.col("toks")) == F.size("chain"))
    cover = hit.groupBy(*keys, "pos").agg(F.count_distinct("item_id").alias("covered"))
    weak = f.join(pool, keys).join(cover, [*keys, "pos"], "left").where(F.coalesce("covered", F.lit(0)) < F.col("pool"))
    el = nodes.select("page_id", "node_id", F.col("path").alias("e_path"), F.col("tag").alias("e_tag"), stable_classes("classes").alias("e_cls"), F.col("depth").alias("e_depth"), F.col("anc_ids").alias("e_anc"))
    items = cands.select("page_id", "rank", F.col("first_id"))
    weak = weak.join(el, ["page_id", "node_id"]).join(items, keys).where(F.size("e_cls") > 0)
    weak = weak.withColumn("last", F.element_at("e_cls", -1)).withColumn(
        "levels", F.col("e_depth") - F.array_position("e_anc", F.col("first_id")).cast("int") + 1
    )
    kid_tags = inside.where(F.col("depth") == F.col("item_depth") + 1).select(*keys, "item_id", "node_id", F.col("tag").alias("k_tag"), F.explode(stable_classes("classes")).alias("last"))
    per_item = kid_tags.groupBy(*keys, "item_id", "last").agg(F.min_by("k_tag", "node_id").alias("k_tag"))
    heads = per_item.groupBy(*keys, "last").agg(F.array_sort(F.collect_set("k_tag")).alias("heads"))
    weak = weak.join(heads, [*keys, "last"], "left")
    many = F.size(F.coalesce("heads", F.array().cast("array<string>"))) >= 2
    none = F.array().cast("array<string>")
    dotted = lambda x: F.concat(F.lit("."), x)
    form = lambda tags, cls: F.struct(tags.alias("tags"), F.transform(cls, dotted).alias("need"))
    last = F.array("last")
    more = F.size("e_cls") > 1
    forms = F.array_compact(F.array(
        F.when(many, form(F.col("heads"), F.col("e_cls"))), form(none, F.col("e_cls")), form(F.array("e_tag"), F.col("e_cls")),
        F.when(more & many, form(F.col("heads"), last)), F.when(more, form(none, last)), F.when(more, form(F.array("e_tag"), last)),
    ))
    up = F.transform(F.slice(_names(F.col("e_path")), F.lit(1), F.greatest("levels", F.lit(0))), lambda s: F.get(stable_classes(F.slice(s, F.lit(2), F.size(s))), F.lit(0)))
    weak = by_page(cut(weak.withColumn("forms", forms).withColumn("up", up)))
    # forms are tried as direct-child paths of one level after the other, then anywhere (n = 0); an element can meet those of
    # its own level and those anywhere. All classes of a form must be there, its last one among them, so only elements with that class are looked at
    own = F.get("toks", F.lit(0))
    own_classes = F.transform(F.array_distinct(F.slice(own, F.lit(2), F.size(own))), lambda t: F.substring(t, F.lit(2), F.length(t)))
    named = inside.select(*keys, "item_id", (F.col("depth") - F.col("item_depth")).alias("level"), "toks", own.alias("own"), F.explode(own_classes).alias("last"))
    fits = lambda fm: F.forall(fm["need"], lambda x: F.array_contains("own", x)) & ((F.size(fm["tags"]) == 0) | F.array_contains(fm["tags"], F.get("own", F.lit(0))))
    inner = F.when(F.col("level") > 1, F.sequence(F.lit(1), F.col("level") - 1)).otherwise(F.array().cast("array<int>"))
    placed = (F.col("level") <= F.size("up")) & F.forall(inner, lambda j: F.coalesce(F.array_contains(F.get("toks", j), dotted(F.get("up", j))), F.lit(False)))
    met = weak.select(*keys, "pos", "pool", "last", "up", "forms").join(named, [*keys, "last"]).select(
        *keys, "pos", "pool", "item_id", F.size("forms").alias("nf"), F.size("up").alias("nu"), F.transform("forms", fits).alias("fit"),
        F.when(placed, F.array(F.col("level"), F.lit(0))).otherwise(F.array(F.lit(0))).alias("ns"))
    met = met.where(F.array_contains("fit", True)).select("*", F.explode_outer("ns").alias("n")).drop("ns")
    ks = range(MAX_FORMS)
    hits = met.groupBy(*keys, "pos", "n", "item_id").agg(
        *[F.first(c).alias(c) for c in ("pool", "nf", "nu")], *[F.count_if(F.get("fit", F.lit(k))).alias(f"h{k}") for k in ks])
    good = hits.groupBy(*keys, "pos", "n").agg(
        *[F.first(c).alias(c) for c in ("pool", "nf", "nu")], *[F.count_if(F.col(f"h{k}") > 0).alias(f"i{k}") for k in ks], *[F.max(f"h{k}").alias(f"h{k}") for k in ks])
    first = F.coalesce(*[F.when((F.col(f"i{k}") == F.col("pool")) & (F.col(f"h{k}") == 1), F.lit(k)) for k in ks])
    good = good.withColumn("k", first).where("k IS NOT NULL")
    place = F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("nu") + 1) * F.col("nf") + F.col("k")
    good = good.groupBy(*keys, "pos").agg(F.min(F.struct(place.alias("place"), "n", "k")).alias("c"))
    good = weak.select(*keys, "pos", "last", "up", "forms").join(good, [*keys, "pos"])
    form = F.get("forms", F.col("c.k"))
    segs = F.when(F.col("c.n") > 1, F.reverse(F.slice("up", F.lit(2), F.greatest(F.col("c.n") - 1, F.lit(0))))).otherwise(none)
    good = good.select(*keys, "pos", "last", F.col("c.place").alias("ci"), F.col("c.n").alias("n"), segs.alias("segs"), form["tags"].alias("tags"), form["need"].alias("need"))
    head = F.when(F.size("tags") > 1, F.concat(F.lit(":is("), F.array_join("tags", ","), F.lit(")"))).otherwise(F.concat_ws("", "tags"))
    dot = lambda xs: F.transform(xs, lambda x: F.concat(F.lit("."), css_escape(x)))
    leaf_text = F.concat(head, F.concat_ws("", F.transform("need", lambda x: F.concat(F.lit("."), css_escape(F.substring(x, F.lit(2), F.length(x)))))))
    text = F.when(F.col("n") == 0, leaf_text).otherwise(F.concat(F.lit(":scope > "), F.array_join(F.concat(dot(F.col("segs")), F.array(leaf_text)), " > ")))
    pick = good.withColumn("better", text).groupBy(*keys, "pos").agg(F.min_by(F.struct("better", "last"), "ci").alias("b"))
    out = fields.join(pick, [*keys, "pos"], "left")
    renamed = F.when(F.col("b").isNotNull() & ~looks_generated("b.last"), F.col("b.last")).otherwise(F.col("name"))
    return out.select(
        *[
            {"selector": F.coalesce("b.better", "selector").alias("selector"), "name": renamed.alias("name")}.get(c, F.col(c))
            for c in source
        ]
    )


# ---- judging candidates and building rules --------------------------------------

def has_image_field(fields) -> Column:
    return F.exists(
        col_of(fields),
        lambda f: F.lower(f["name"]).contains("image") | F.lower(f["name"]).contains("thumb")
        | F.coalesce(F.lower(f["attribute"]).isin("src", "srcset", "data-src"), F.lit(False)),
    )


def looks_like_data(item_selector, container_selector, count, fields=None) -> Column:
    """Data rows rather than navigation: image field, else words, else number of items."""
    hay = F.lower(F.concat_ws(" ", col_of(item_selector), col_of(container_selector)))
    words = lambda ws: reduce(Column.__or__, [hay.contains(x) for x in ws])
    rest = F.when(words(NAV_HINTS), False).when(words(DATA_HINTS), True).otherwise(col_of(count) >= MIN_DATA_ITEMS)
    return rest if fields is None else F.when(F.coalesce(has_image_field(fields), F.lit(False)), True).otherwise(rest)


def with_fields(cands: DataFrame, fields: DataFrame) -> DataFrame:
    """Candidates with their fields as one array in order."""
    arr = fields.groupBy("page_id", "rank").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "selector", "attribute"))).alias("f"))
    none = F.array().cast("array<struct<name:string,selector:string,attribute:string>>")
    return cands.join(arr, ["page_id", "rank"], "left").withColumn(
        "fields",
        F.coalesce(F.transform("f", lambda x: F.struct(x["name"].alias("name"), x["selector"].alias("selector"), x["attribute"].alias("attribute"))), none),
    ).drop("f")


def page_has_content(cands: DataFrame, stats: DataFrame) -> DataFrame:
    """Per page: a list that looks like data, or many links, or many images."""
    fields = F.col("fields") if "fields" in cands.columns else None
    data = cands.groupBy("page_id").agg(F.max(looks_like_data("item_selector", "container_selector", "count", fields)).alias("d"))
    return stats.join(data, "page_id", "left").select(
        "page_id",
        (F.coalesce("d", F.lit(False)) | (F.col("links") >= MIN_LINKS) | (F.col("images") >= MIN_IMAGES)).alias("has_content"),
    )


def normalize_field_name(name, attribute) -> Column:
    n = F.lower(F.trim(F.coalesce(col_of(name), F.lit(""))))
    has = lambda ws: reduce(Column.__or__, [n.contains(w) for w in ws])
    clean = F.regexp_replace(n, r"[^\p{L}\p{N}_]", "_")
    return (
        F.when(F.coalesce(col_of(attribute) == "href", F.lit(False)) | has(("link", "href", "url")), "link")
        .when(has(("price", "价", "amount")), "price")
        .when(has(("title", "name", "标题", "名称", "text")), "title")
        .when(has(("img", "image", "pic", "图")), "image")
        .otherwise(F.when(clean == "", "field").otherwise(clean))
    )


def default_transforms(name, attribute) -> Column:
    n, a = col_of(name), F.lower(F.coalesce(col_of(attribute), F.lit("")))
    media = n.isin("link", "image", "audio", "video") | a.isin("src", "href", "data-src", "data-original", "data-bg", "srcset")
    return F.when(n == "price", F.array(F.lit("price"))).when(media, F.array(F.lit("url"))).otherwise(F.array(F.lit("strip")))


def candidate_score(count, fields) -> Column:
    """4 per distinct selector and attribute, 1 per field, items up to 20, 6 for an image."""
    distinct = F.size(F.array_distinct(F.transform(col_of(fields), lambda f: F.struct(f["selector"], f["attribute"]))))
    return distinct * 4 + F.size(col_of(fields)) + F.least(col_of(count), F.lit(20)) + F.when(has_image_field(fields), 6).otherwise(0)


def build_rules(cands: DataFrame, paging: DataFrame | None = None, max_pages: int = 1, by: str = "page_id", field_limit: int | None = None) -> DataFrame:
    """Best candidate per page, or per site template (``by``), as a rule.

    ``max_by`` is combined map-side, so a template may own any share of the pages.
    """
    d = cands.where(F.size("fields") >= 2).withColumn("score", candidate_score("count", "fields"))
    best = d.groupBy(by).agg(
        F.max_by(
            F.struct("item_selector", "container_selector", "count", "fields", "score", "page_id"),
            F.struct("score", (-F.col("rank")).alias("r"), (-F.col("page_id")).alias("p")),
        ).alias("c")
    )
    fields = F.transform(
        F.col("c.fields") if field_limit is None else F.slice("c.fields", 1, field_limit),
        lambda f: let(
            normalize_field_name(f["name"], f["attribute"]),
            lambda n: F.struct(
                n.alias("name"), f["selector"].alias("selector"), f["attribute"].alias("attribute"),
                default_transforms(n, f["attribute"]).alias("transform"), F.lit(False).alias("required"),
            ),
        ),
    )
    # several fields can normalize to one name: the later ones are numbered
    def numbered(fs: Column) -> Column:
        def one(f: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(fs, F.lit(1), i), lambda g: g["name"] == f["name"]))
            name = F.when(before == 0, f["name"]).otherwise(F.concat(f["name"], F.lit("_"), (before + 1).cast("string")))
            return F.struct(name.alias("name"), *[f[c].alias(c) for c in ("selector", "attribute", "transform", "required")])

        return F.transform(fs, one)

    fields = let(fields, numbered)
    out = best.select(
        by, F.lit("dom").alias("mode"),
        F.struct(F.col("c.item_selector").alias("item_selector"), fields.alias("fields")).alias("list_rule"),
        F.col("c.score").alias("score"), F.col("c.count").alias("count"), F.col("c.page_id").alias("sample_page_id"),
        F.lit("rule").alias("source"),
    )
    if paging is None:
        return out.withColumn("pagination", F.lit(None).cast("struct<next_selector:string,max_pages:int>"))
    p = paging.select(F.col("page_id").alias("sample_page_id"), "next_selector")
    return out.join(p, "sample_page_id", "left").withColumn(
        "pagination", F.when(F.col("next_selector").isNotNull(), F.struct("next_selector", F.lit(max_pages).alias("max_pages")))
    ).drop("next_selector")
