"""Per-page reports: statistics, metadata, text, outline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webframe.functions import text as T
from webframe.operators.structure import LAZY_ATTRS, SKIP_TAGS, stable_classes

# What the reports look for.
ERROR_CLASS = ("error", "alert", "notice", "warn", "tip", "message")
AUTH_HREF = r"(?i)login|signin|sign-in|auth|register|signup|passport"
CAPTCHA_SRC = ("captcha", "recaptcha", "hcaptcha", "turnstile", "challenge")
CAPTCHA_CLASS = ("captcha", "geetest", "slider", "turnstile")
ROLE_ORDER = ("heading", "error", "form", "captcha", "button", "message", "link", "meta")
#: How many texts of a role a short report for a person shows.
ROLE_LIMITS = {"heading": 6, "error": 6, "form": 4, "captcha": 3, "button": 8, "message": 6, "link": 8, "meta": 4}
TREE_DEPTH, TREE_NODES, TREE_CHILDREN, TREE_INDENT = 24, 1200, 80, 12
TREE_TEXT, TREE_HREF, TREE_URL = 60, 80, 150
SEMANTIC_TAGS = ("ul", "ol", "article", "section", "main", "table", "figure")

TEXT_COLUMNS = (
    "node_id", "end_id", "parent_id", "depth", "nth_of_type", "type_count", "n_kids", "tag", "elem_id", "classes",
    "attrs", "path", "anc_ids", "own_text", "text", "hidden",
)
TREE_COLUMNS = (
    "node_id", "end_id", "parent_id", "depth", "n_kids", "tag", "elem_id", "classes", "attrs", "text", "text_len",
    "n_links", "n_imgs", "anc_ids",
)


def _attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def dom_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("page_id").agg(
        F.count("*").alias("total_elements"),
        F.count_if((F.col("tag") == "a") & F.map_contains_key("attrs", "href")).alias("links"),
        F.count_if(F.col("tag") == "img").alias("images"),
        F.count_if(F.col("tag") == "iframe").alias("iframes"),
        F.count_if(F.col("tag") == "form").alias("forms"),
    )


def _ordered(value: Column, when: Column, order: str = "node_id") -> Column:
    """Values in document order as one array (bounded by the page)."""
    pairs = F.array_sort(F.collect_list(F.when(when, F.struct(F.col(order).alias("o"), value.alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def structured_metadata(nodes: DataFrame) -> DataFrame:
    """JSON-LD blocks, ``og:``/``twitter:`` values and microdata of every page.

    ``json_ld`` keeps the JSON texts that parse; of repeated meta names the last
    one counts; microdata elements are in document order.
    """
    is_ld = (F.col("tag") == "script") & (_attr("type") == "application/ld+json") & F.try_parse_json("own_text").isNotNull()
    prop, name = _attr("property"), _attr("name")
    is_og = (F.col("tag") == "meta") & (prop.startswith("og:") | name.startswith("twitter:"))
    has = lambda k: F.map_contains_key("attrs", k)
    content = F.when(has("content"), _attr("content")).when(has("href"), _attr("href")).when(has("src"), _attr("src"))
    micro = F.struct(
        _attr("itemprop").alias("itemprop"), F.col("tag").alias("tag"), content.alias("content"),
        F.when(content.isNull(), F.col("text")).alias("text"),
    )
    rows = nodes.where(is_ld | is_og | has("itemprop")).withColumn("_m", has("itemprop"))
    key = F.when(prop != "", prop).otherwise(name)
    got = rows.groupBy("page_id").agg(
        _ordered(F.trim(F.col("own_text")), is_ld).alias("json_ld"),
        _ordered(F.struct(key.alias("k"), _attr("content").alias("v")), is_og).alias("_og"),
        _ordered(micro, F.col("_m")).alias("microdata"),
    )
    last = F.filter("_og", lambda p, i: ~F.exists(F.slice("_og", i + 2, F.greatest(F.size("_og"), F.lit(1))), lambda q: q["k"] == p["k"]))
    return got.withColumn("open_graph", F.map_from_entries(last)).select("page_id", "json_ld", "open_graph", "microdata")


def page_titles(nodes: DataFrame) -> DataFrame:
    return nodes.where("tag = 'title'").groupBy("page_id").agg(F.min_by("text", "node_id").alias("title"))


def element_selector() -> Column:
    """Short, readable (not necessarily unique) selector of an element."""
    cls = F.concat_ws("", F.transform(F.slice("classes", 1, 2), lambda c: F.concat(F.lit("."), c)))
    nth = F.when((F.col("type_count") > 1) & ~F.col("path").rlike(r"^html[^/]*/body[^/]*/[^/]+$"), F.concat(F.lit(":nth-of-type("), F.col("nth_of_type").cast("string"), F.lit(")"))).otherwise("")
    return F.when(F.col("elem_id").isNotNull(), F.concat(F.lit("#"), "elem_id")).otherwise(F.concat("tag", cls, nth))


def page_text(nodes: DataFrame) -> DataFrame:
    """What a page shows: body and main text, headings, error blocks, forms, buttons, sign-in links.

    Visibility is what static markup tells (``hidden``, inline style); sizes are
    unknown. ``main_text`` is the text of the first main element without its
    navigation, header, footer and side parts.
    """
    tag, t = F.col("tag"), T.norm_text("text")
    lower_cls = F.lower(F.array_join("classes", " "))
    lower_id = F.lower(F.coalesce("elem_id", F.lit("")))
    shown = ~F.col("hidden")
    has_cls = lambda ws: reduce(Column.__or__, [lower_cls.contains(w) for w in ws])
    is_main = tag.isin("main", "article") | (_attr("role") == "main") | F.arrays_overlap("classes", F.array(F.lit("content"), F.lit("container"))) | (F.col("elem_id") == "content")
    w = Window.partitionBy("page_id")
    body_id = F.min(F.when(tag == "body", F.col("node_id"))).over(w)
    d = nodes.withColumn("_main", F.coalesce(F.min(F.when(is_main, F.col("node_id"))).over(w), body_id))
    skip = r"(^|/)(nav|header|footer|aside|script|style)[#.:]|\.(nav|footer|sidebar)[.:]"
    d = d.withColumn("_mdepth", F.min(F.when(F.col("node_id") == F.col("_main"), F.col("depth"))).over(w))
    below = F.expr("substring_index(path, '/', _mdepth - depth)")
    in_main = ((F.col("node_id") > F.col("_main")) & F.array_contains("anc_ids", F.col("_main")) & ~below.rlike(skip)) | (F.col("node_id") == F.col("_main"))
    is_error = (has_cls(ERROR_CLASS) | lower_id.contains("error") | (_attr("role") == "alert")) & shown & (F.col("n_kids") <= 8) & (F.length(t) >= 2)
    is_form = (tag == "form") & shown
    is_pw = (tag == "input") & (F.lower(_attr("type")) == "password")
    is_button = (tag == "button") | ((tag == "input") & (F.lower(_attr("type")) == "submit")) | (_attr("role") == "button") | ((tag == "a") & F.arrays_overlap("classes", F.array(F.lit("button"), F.lit("btn"))))
    label = F.when(F.trim("text") != "", F.trim("text")).otherwise(F.trim(_attr("value")))
    href = _attr("href")
    is_auth = (tag == "a") & href.rlike(AUTH_HREF)
    auth = F.struct(F.when(F.trim("text") == "", href).otherwise(F.trim("text")).alias("text"), href.alias("href"), element_selector().alias("selector"))
    src = F.lower(_attr("src"))
    is_captcha = shown & (
        ((tag == "iframe") & reduce(Column.__or__, [src.contains(c) for c in CAPTCHA_SRC]))
        | has_cls(CAPTCHA_CLASS) | lower_id.contains("captcha") | F.map_contains_key("attrs", "data-sitekey")
    )
    is_input = tag == "input"
    form_up = F.array_max(F.transform("anc_ids", lambda a, i: F.when(F.get(F.split("path", "/"), i).rlike(r"^form[#.:]"), a)))
    d = d.withColumn("_form", F.when(is_form, F.col("node_id")).when(is_input, form_up))
    meta_key = F.when(_attr("name") != "", _attr("name")).otherwise(_attr("property"))
    is_meta = (tag == "meta") & meta_key.rlike(r"(?i)error|status|code|message|title|description") & (_attr("content") != "") & (F.length(_attr("content")) < 300)
    out = d.groupBy("page_id").agg(
        F.coalesce(F.min_by("text", F.when(tag == "title", F.col("node_id"))), F.lit("")).alias("title"),
        F.coalesce(F.min_by(t, F.when(tag == "body", F.col("node_id"))), F.lit("")).alias("body_text"),
        F.array_join(_ordered(F.col("own_text"), in_main & shown & (F.col("own_text") != "")), "\n").alias("main_text"),
        _ordered(F.struct("tag", element_selector().alias("selector"), t.alias("text")), tag.isin("h1", "h2", "h3") & shown & (t != "")).alias("headings"),
        _ordered(F.struct(element_selector().alias("selector"), t.alias("text")), is_error).alias("error_blocks"),
        _ordered(F.struct("node_id", element_selector().alias("selector"), _attr("action").alias("action"), F.lower(F.when(_attr("method") == "", "get").otherwise(_attr("method"))).alias("method")), is_form).alias("_forms"),
        _ordered(F.struct(F.col("_form").alias("form"), F.when(_attr("name") != "", _attr("name")).otherwise(_attr("type")).alias("name"), is_pw.alias("pw")), is_input & F.col("_form").isNotNull()).alias("_inputs"),
        F.count_if(is_pw & shown).alias("password_inputs"),
        F.array_distinct(_ordered(label, is_button & shown & (label != ""))).alias("buttons"),
        _ordered(auth, is_auth).alias("auth_links"),
        _ordered(element_selector(), is_captcha).alias("captcha"),
        _ordered(F.struct(meta_key.alias("k"), _attr("content").alias("v")), is_meta).alias("meta"),
        F.count("*").alias("dom_nodes"),
        F.count_if(((tag == "a") & F.map_contains_key("attrs", "href")) | tag.isin("button", "input", "select", "textarea")).alias("interactive_count"),
    )
    forms = F.transform(
        "_forms",
        lambda f: F.struct(
            f["selector"].alias("selector"), f["action"].alias("action"), f["method"].alias("method"),
            F.exists("_inputs", lambda i: (i["form"] == f["node_id"]) & i["pw"]).alias("has_password"),
            F.transform(F.filter("_inputs", lambda i: i["form"] == f["node_id"]), lambda i: i["name"]).alias("inputs"),
        ),
    )
    return out.withColumn("forms", forms).drop("_forms", "_inputs")


def text_elements(pt: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Key texts of a page by role, equal ones once; with ``limits`` (such as ``ROLE_LIMITS``) the first of each role."""
    role = lambda r, sel, tag, text: F.struct(F.lit(ROLE_ORDER.index(r)).alias("o"), F.lit(r).alias("role"), tag.alias("tag"), sel.alias("selector"), text.alias("text"))
    form_text = lambda f: F.concat(
        F.lit("form "), F.upper(f["method"]), F.lit(" "), F.when(f["action"] == "", "(this page)").otherwise(f["action"]),
        F.when(F.size(f["inputs"]) > 0, F.concat(F.lit(" fields: "), F.array_join(F.filter(f["inputs"], lambda x: x != ""), ", "))).otherwise(""),
        F.when(f["has_password"], " with password").otherwise(""),
    )
    parts = F.concat(
        F.transform("headings", lambda h: role("heading", h["selector"], h["tag"], T.flatten_text(h["text"], None))),
        F.transform("error_blocks", lambda e: role("error", e["selector"], F.lit("div"), T.flatten_text(e["text"], None))),
        F.transform("forms", lambda f: role("form", f["selector"], F.lit("form"), form_text(f))),
        F.transform("captcha", lambda c: role("captcha", c, F.lit("div"), F.lit("challenge element"))),
        F.transform("buttons", lambda b: role("button", F.lit(""), F.lit("button"), T.flatten_text(b, None))),
    )
    rows = pt.select("page_id", F.posexplode(parts).alias("i", "e")).select("page_id", "i", "e.*").where("text != ''")
    once = Window.partitionBy("page_id", "role", "text").orderBy("i")
    rows = rows.withColumn("_d", F.row_number().over(once)).where("_d = 1")
    cap = Window.partitionBy("page_id", "role").orderBy("i")
    rows = rows.withColumn("pos", F.row_number().over(cap))
    if limits:
        most = F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("role"))
        rows = rows.where(most.isNull() | (F.col("pos") <= most))
    return rows.select("page_id", "o", "pos", "role", "tag", "selector", "text")


def simplified_tree(
    nodes: DataFrame, max_depth: int = TREE_DEPTH, max_nodes: int = TREE_NODES,
    child_cap: int = TREE_CHILDREN, indent_cap: int = TREE_INDENT, scope: DataFrame | None = None,
) -> DataFrame:
    """Text outline of every page, the part with content first.

    Siblings are ordered by a content score from the subtree counts of each
    element. The walk order is the order of the sort keys of all ancestors, so
    no recursion is needed: every element looks up the sibling position of each
    of its ancestors, and elements cut anywhere above are gone.
    ``scope`` (page_id, node_id, end_id) starts the outline at one element.
    """
    body = nodes.where("tag = 'body'").groupBy("page_id").agg(F.min_by(F.struct("node_id", "end_id", "depth"), "node_id").alias("r"))
    root = body.select("page_id", F.col("r.node_id").alias("r_id"), F.col("r.end_id").alias("r_end"), F.col("r.depth").alias("r_depth"))
    if scope is not None:
        s = scope.join(nodes.select("page_id", "node_id", "depth"), ["page_id", "node_id"]).select(
            "page_id", F.col("node_id").alias("s_id"), F.col("end_id").alias("s_end"), F.col("depth").alias("s_depth")
        )
        root = root.join(s, "page_id", "left").select(
            "page_id", F.coalesce("s_id", "r_id").alias("r_id"), F.coalesce("s_end", "r_end").alias("r_end"), F.coalesce("s_depth", "r_depth").alias("r_depth")
        )
    own_img = (F.col("tag") == "img").cast("int")
    own_link = ((F.col("tag") == "a") & F.map_contains_key("attrs", "href")).cast("int")
    score = (
        (F.col("n_imgs") - own_img) * 6 + (F.col("n_links") - own_link) * 3 + F.least(F.col("text_len"), F.lit(400)) / 20
        + F.when(F.col("tag").isin(*SEMANTIC_TAGS), 4).otherwise(0)
    )
    d = nodes.join(root, "page_id").where((F.col("node_id") >= F.col("r_id")) & (F.col("node_id") <= F.col("r_end")))
    w = Window.partitionBy("page_id", "parent_id").orderBy(F.desc(score), "node_id")
    d = d.withColumn("place", F.row_number().over(w)).withColumn("level", F.col("depth") - F.col("r_depth"))
    bad = (F.col("level") > 0) & ((F.col("place") > child_cap) | F.col("tag").isin(*SKIP_TAGS))
    marks = d.select("page_id", F.col("node_id").alias("up"), "place", bad.alias("bad"))
    ups = d.where(F.col("level") <= max_depth).select(
        "page_id", "node_id", F.posexplode(F.concat(F.slice("anc_ids", F.col("r_depth") + 1, F.col("level")), F.array("node_id"))).alias("i", "up")
    ).join(marks, ["page_id", "up"])
    key = ups.groupBy("page_id", "node_id").agg(
        F.max("bad").alias("bad"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "place"))), lambda p: p["place"]).alias("key"),
    ).where(~F.col("bad"))
    lazy = F.coalesce(*[F.when(F.trim(_attr(a)) != "", F.lit(a)) for a in LAZY_ATTRS])
    lazy_value = F.coalesce(*[F.nullif(F.trim(_attr(a)), F.lit("")) for a in LAZY_ATTRS])
    address = F.when(
        F.col("tag").isin("img", "source"),
        F.coalesce(lazy_value, F.nullif(_attr("src"), F.lit("")), F.nullif(_attr("srcset"), F.lit(""))),
    ).when(F.col("tag").isin("video", "audio"), F.nullif(_attr("src"), F.lit("")))
    address = F.split_part(F.trim(address), F.lit(" "), F.lit(1))
    long = F.length(address) > TREE_URL
    shorter = F.concat(F.substring(address, 1, TREE_URL - 52), F.lit("/…/"), F.right(address, F.lit(46)))
    line = F.concat(
        F.repeat(F.lit("  "), F.least(F.col("level"), F.lit(indent_cap - 1))),
        "tag", F.when(F.col("elem_id").isNotNull(), F.concat(F.lit("#"), "elem_id")).otherwise(""),
        F.concat_ws("", F.transform(F.slice(stable_classes("classes"), 1, 3), lambda c: F.concat(F.lit("."), c))),
        F.when(F.col("n_kids") == 0, F.concat(F.lit(" "), F.regexp_replace(F.substring(F.trim("text"), 1, TREE_TEXT), r"\s+", " "))).otherwise(""),
        F.when((F.col("tag") == "a") & (_attr("href") != ""), F.concat(F.lit(" -> "), F.substring(_attr("href"), 1, TREE_HREF))).otherwise(""),
        F.when(
            address.isNotNull(),
            F.concat(F.when(lazy.isNotNull() & F.col("tag").isin("img", "source"), F.concat(F.lit(" ["), lazy, F.lit("]"))).otherwise(""), F.lit(" -> "), F.when(long, shorter).otherwise(address)),
        ).otherwise(""),
    )
    lines = d.select("page_id", "node_id", "tag", line.alias("line")).join(key, ["page_id", "node_id"])
    at = Window.partitionBy("page_id").orderBy("key")
    lines = lines.withColumn("n", F.row_number().over(at))
    kept = F.col("n") <= max_nodes
    out = lines.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("n", "line")))), lambda p: p["line"]), "\n").alias("tree"),
        F.least(F.count("*"), F.lit(max_nodes)).alias("nodes"),
        (F.count("*") >= max_nodes).alias("truncated_nodes"),
        F.count_if(kept & (F.col("tag") == "img")).alias("images_in_tree"),
    )
    whole = d.groupBy("page_id").agg(F.max("level").alias("deepest"), F.count_if(F.col("tag") == "img").alias("images_in_dom"))
    return out.join(whole, "page_id").select(
        "page_id", "tree", "nodes", "truncated_nodes", (F.col("deepest") > max_depth).alias("truncated_depth"),
        "images_in_dom", "images_in_tree",
        F.when(F.col("images_in_dom") > 0, F.round(F.col("images_in_tree") / F.col("images_in_dom"), 4)).otherwise(1.0).alias("image_coverage"),
    )


def richest_document(docs: DataFrame) -> DataFrame:
    """Of several documents of a page the one with most to offer.

    ``docs``: page_id, doc_no (0 is the outer one), scope_matched, candidates,
    elements, images. ``incomplete``: the best inner document is hardly larger
    than the outer shell.
    """
    order = F.struct(F.col("scope_matched").cast("int").alias("s"), "candidates", "elements", "images", (-F.col("doc_no")).alias("d"))
    g = docs.groupBy("page_id").agg(
        F.max_by(F.struct("doc_no", "candidates", "elements", "images"), order).alias("b"),
        F.max(F.when(F.col("doc_no") > 0, F.col("elements"))).alias("inner"),
        F.max(F.when(F.col("doc_no") == 0, F.col("elements"))).alias("outer"),
    )
    return g.select("page_id", "b.*", F.coalesce(F.col("inner") <= F.col("outer") * 1.2, F.lit(False)).alias("incomplete"))
