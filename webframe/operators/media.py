"""Media addresses in captures, pages and items; rewriting and checking them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.functions.common import col_of, let
from webframe.functions.jsonpath import flatten_json
from webframe.functions.media import KIND_EXT, PLAYABLE, has_moov, media_score, sniff_kind
from webframe.functions.urls import absolute_media_url, inner_urls, url_part
from webframe.operators import selectors as S
from webframe.plans.ordering import sequence_number, top_per_key

MIN_SCORE = 20
TEXT_URL = r"https?://[^\s\"'<>\\]{12,500}"


def sniff_media_urls(
    captures: DataFrame, run: Sequence[str] = ("page_url",), min_score: int = MIN_SCORE, limit: int | None = None
) -> DataFrame:
    """Media addresses in captured responses, best first, of each run; at most ``limit`` of them if given.

    Every string in a JSON body (or every URL in a text body) is scored; URLs
    carried in the query of an accepted one are scored too. An address counts
    once per run, where it is first found.
    """
    run = list(run)
    leaf = "struct<path:string,value:string,is_text:boolean>"
    from_json = F.filter(
        flatten_json(F.col("body_json")), lambda v: v["is_text"] & v["value"].rlike(r"^\s*https?://")
    )
    from_text = F.transform(
        F.regexp_extract_all("body_text", F.lit(TEXT_URL), 0),
        lambda u: F.struct(F.lit("(text)").alias("path"), u.alias("value"), F.lit(True).alias("is_text")),
    )
    leaves = F.when(F.col("body_json").isNotNull(), from_json).when(F.col("body_text").contains("://"), from_text)

    # scored and filtered inside the array: a filter on exploded columns would be
    # pushed below and score every address several times
    def scored(u: Column, path: Column, depth: int, label: Column) -> Column:
        return F.struct(u.alias("url"), label.alias("field"), media_score(u, path).alias("score"), F.lit(depth).alias("depth"))

    def candidates(v: Column) -> Column:
        url = F.trim(v["value"])

        def with_inner(own: Column) -> Column:
            label = F.concat(v["path"], F.lit(" (inner)"))
            nested = F.filter(F.transform(inner_urls(own["url"]), lambda u: scored(u, v["path"], 1, label)), lambda x: x["score"] >= min_score)
            none = F.array().cast("array<struct<url:string,field:string,score:int,depth:int>>")
            return (
                F.when(own["score"] >= min_score, F.concat(F.array(own), nested))
                .when(own["score"] < 0, F.array(own))
                .otherwise(none)
            )

        return let(scored(url, v["path"], 0, v["path"]), with_inner)

    leaves = leaves.cast(f"array<{leaf}>")
    both = captures.select(
        *run, "id", F.col("url").alias("source_url"), F.posexplode(F.flatten(F.transform(leaves, candidates))).alias("pos", "c")
    ).select(*run, "id", "source_url", "pos", "c.field", "c.url", "c.score", "c.depth")
    rest = [c for c in both.columns if c not in run]
    first = both.withColumn("_key", F.split_part("url", F.lit("#"), F.lit(1)))
    first = first.groupBy(*run, "_key").agg(F.min_by(F.struct(*rest), F.struct("id", "pos", "depth")).alias("r")).select(*run, "r.*")
    good = first.where(F.col("score") >= min_score).drop("depth")
    if limit is not None:
        return top_per_key(good, run, [F.desc("score"), F.length("url"), F.col("url")], limit, "position")
    # higher scores first, then shorter addresses: one number that spreads well
    placed = good.withColumn("_o", F.length("url") - F.col("score") * F.lit(100_000))
    return sequence_number(placed, run, ["_o", "url"], "position").drop("_o")


def item_urls(items: DataFrame, field: str, exts: Sequence[str] = (), keys: Sequence[str] = ("page_id", "item_id")) -> DataFrame:
    """Addresses in one field: lists as they are, texts split at ';' and ','."""
    kind = dict(items.dtypes)[field]
    values = F.col(field) if kind.startswith("array") else F.split(field, "[;,]")
    d = items.select(*keys, F.posexplode(values).alias("pos", "url")).withColumn("url", F.trim("url")).where("url != ''")
    if exts:
        path = F.lower(url_part("url", "path"))
        d = d.where(reduce(Column.__or__, [path.endswith(e) for e in exts]))
    return d


def dom_urls(nodes: DataFrame, selector: str, attribute: str = "src") -> DataFrame:
    """Addresses of matching elements; lazy-loading attributes stand in for a missing ``src``."""
    at = lambda n: F.nullif(F.try_element_at("attrs", F.lit(n)), F.lit(""))
    value = F.split_part(F.trim(F.split_part(at("srcset"), F.lit(","), F.lit(1))), F.lit(" "), F.lit(1)) if attribute == "srcset" else at(attribute)
    if attribute == "src":
        value = F.coalesce(value, at("data-src"), at("data-original"))
    return S.select_nodes(nodes, selector).select("page_id", "node_id", value.alias("url")).where("url is not null and url != ''")


def collect_media_urls(parts: Sequence[DataFrame], pages: DataFrame, limits: DataFrame | None = None, default: int | None = None) -> DataFrame:
    """Union of address sources, absolute, first seen per page, up to the page's limit (or the default one) where there is one.

    Each part has ``page_id``, ``url`` and a sort key ``seq``; parts come in the
    given order. Duplicates are reduced map-side before positions are counted.
    """
    both = reduce(
        DataFrame.unionByName,
        [p.select("page_id", F.lit(i).alias("part"), F.col("seq").cast("long").alias("seq"), F.col("url").alias("raw")) for i, p in enumerate(parts)],
    )
    base = both.join(pages.select("page_id", F.col("url").alias("base")), "page_id")
    d = base.withColumn("url", absolute_media_url("base", "raw")).where("url != ''")
    first = d.groupBy("page_id", "url").agg(F.min(F.struct("part", "seq")).alias("f"))
    first = first.select("page_id", "url", F.col("f.part").alias("part"), F.col("f.seq").alias("seq"))
    ranked = sequence_number(first.withColumn("_o", F.col("part") * F.lit(1 << 40) + F.col("seq")), ["page_id"], ["_o", "url"], "position").drop("_o")
    if limits is not None:
        ranked = ranked.join(limits.select("page_id", F.col("limit").alias("_l")), "page_id", "left")
        most = F.coalesce("_l", F.lit(default).cast("long"))
        return ranked.where(most.isNull() | (F.col("position") <= most)).drop("_l")
    return ranked if default is None else ranked.where(F.col("position") <= default)


def pattern_urls(items: DataFrame, pattern: str, text: str = "data") -> DataFrame:
    """Absolute URLs in a text column that match *pattern*, in order."""
    hits = F.filter(F.regexp_extract_all(text, F.lit(r"https?://[^\s\"'<>]+"), 0), lambda u: u.rlike("(?i)" + pattern))
    return items.select(*[c for c in items.columns if c != text], F.posexplode(F.array_distinct(hits)).alias("pos", "url"))


def min_width(urls: DataFrame, sizes: DataFrame, width: int, keys: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Drop images known to be narrower; unknown or zero width stays."""
    known = sizes.groupBy(*keys).agg(F.max("width").alias("width"))
    d = urls.join(known, list(keys), "left")
    return d.where(F.col("width").isNull() | (F.col("width") == 0) | (F.col("width") >= width))


def image_sizes(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Widths that image elements declare, by absolute address."""
    at = lambda n: F.try_element_at("attrs", F.lit(n))
    d = nodes.where("tag = 'img'").select("page_id", at("src").alias("raw"), at("width").try_cast("int").alias("width"))
    d = d.where("raw is not null and width is not null").join(pages.select("page_id", F.col("url").alias("base")), "page_id")
    return d.select("page_id", absolute_media_url("base", "raw").alias("url"), "width")


_TOKEN = r"([\w-]+|[^\w-])"
_WORD = "[A-Za-z0-9]"


def _anchors(pairs: DataFrame) -> DataFrame:
    """``seq, anchors``: places (i, j) of the tokens that occur once on either side, in the order of the left one."""
    def side(col: str, place: str) -> DataFrame:
        tokens = pairs.select("seq", F.posexplode(F.regexp_extract_all(col, F.lit(_TOKEN), 1)).alias(place, "tok"))
        return tokens.groupBy("seq", "tok").agg(F.count("*").alias("n"), F.min(place).alias(place)).where("n = 1").drop("n")

    both = side("thumb", "i").join(side("original", "j"), ["seq", "tok"])
    return both.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("anchors"))


def _rising(anchors: Column) -> Column:
    """The longest run of anchors that rises on both sides."""
    best = "array<struct<n:int,back:int,j:int,chain:array<struct<i:int,j:int>>>>"

    def add(acc: Column, x: Column) -> Column:
        before = F.array_max(F.filter(acc, lambda e: e["j"] < x["j"]))
        none = F.array().cast("array<struct<i:int,j:int>>")
        chain = F.array_append(F.coalesce(before["chain"], none), x)
        return F.array_append(acc, F.struct((F.coalesce(before["n"], F.lit(0)) + 1).alias("n"), (-F.size(acc)).alias("back"), x["j"].alias("j"), chain.alias("chain")))

    chains = F.aggregate(anchors, F.array().cast(best), add)
    return F.coalesce(F.array_max(chains)["chain"], F.array().cast("array<struct<i:int,j:int>>"))


def _equal_head(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    least = F.least(F.size(a), F.size(b))
    return F.aggregate(
        F.sequence(F.lit(0), least), F.lit(0),
        lambda n, k: F.when((n == k) & (k < least) & (F.get(a, k) == F.get(b, k)), n + 1).otherwise(n),
    )


def _tail_from(a: Column, n: Column) -> Column:
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def _gap(ta: Column, tb: Column, left: Column, right: Column) -> Column:
    """What differs between two anchors as ``struct(old, new)`` of joined tokens, null if nothing does."""
    sa = F.slice(ta, left["i"] + 2, right["i"] - left["i"] - 1)
    sb = F.slice(tb, left["j"] + 2, right["j"] - left["j"] - 1)

    def trimmed(s: Column) -> Column:
        ra, rb = F.reverse(_tail_from(s["a"], s["n"])), F.reverse(_tail_from(s["b"], s["n"]))
        return let(F.struct(ra.alias("ra"), rb.alias("rb"), s["n"].alias("n")), lambda t: let(_equal_head(t["ra"], t["rb"]), lambda m: F.struct(
            F.reverse(_tail_from(t["ra"], m)).alias("a"), F.reverse(_tail_from(t["rb"], m)).alias("b"),
            # a pure insertion also takes what is before it, back to a word
            F.reverse(F.slice(ta, F.lit(1), left["i"] + t["n"] + 1)).alias("before"),
        )))

    def named(g: Column) -> Column:
        word = F.array_position(F.transform(g["before"], lambda x: x.rlike(_WORD)), True).cast("int")
        back = F.slice(g["before"], F.lit(1), F.when(word > 0, word).otherwise(F.size(g["before"])))
        lead = F.when(F.size(g["a"]) == 0, F.array_join(F.reverse(back), "")).otherwise("")
        old, new = F.concat(lead, F.array_join(g["a"], "")), F.concat(lead, F.array_join(g["b"], ""))
        pa, pb = F.split(old, "_"), F.split(new, "_")
        differ = F.filter(F.arrays_zip(pa.alias("x"), pb.alias("y")), lambda z: z["x"] != z["y"])
        narrow = (F.size(g["a"]) == 1) & (F.size(pa) == F.size(pb)) & (F.size(differ) == 1) & F.get(differ, F.lit(0))["x"].rlike("[A-Za-z]")
        out = F.when(narrow, F.struct(F.get(differ, F.lit(0))["x"].alias("old"), F.get(differ, F.lit(0))["y"].alias("new"))).otherwise(F.struct(old.alias("old"), new.alias("new")))
        return F.when((F.size(g["a"]) > 0) | (F.size(g["b"]) > 0), out)

    return let(F.struct(sa.alias("a"), sb.alias("b")), lambda s: let(
        F.struct(s["a"].alias("a"), s["b"].alias("b"), _equal_head(s["a"], s["b"]).alias("n")), lambda t: let(trimmed(t), named)))


def _rule(changes: Column) -> Column:
    """``struct(pattern, replacement, literal)``: the differing tokens, with anything (kept) between them."""
    guard = lambda at, look: F.when(at.rlike(_WORD), F.lit(look)).otherwise("")
    first, last = lambda c: F.substring(c, 1, 1), lambda c: F.call_function("right", c, F.lit(1))
    one = lambda c: F.concat(
        guard(first(c["old"]), f"(?<!{_WORD})"), F.regexp_replace(c["old"], r"([^\w\s-])", r"\\$1"), guard(last(c["old"]), f"(?!{_WORD})"))
    new = lambda c, k: F.concat(F.when(k > 0, F.concat(F.lit("$"), k.cast("string"))).otherwise(""), F.regexp_replace(c["new"], r"([\\$])", r"\\$1"))
    return F.struct(
        F.array_join(F.transform(changes, one), "(.*?)").alias("pattern"), F.array_join(F.transform(changes, new), "").alias("replacement"),
        F.regexp_extract(F.get(changes, F.lit(0))["old"], f"{_WORD}+", 0).alias("literal"),
    )


def derive_rewrite_rules(pairs: DataFrame) -> DataFrame:
    """Rewrite rules from (thumb, original) pairs, equal ones once, in pair order.

    The tokens of both addresses are rows; those that occur once on either side are
    anchors, the longest run of anchors in the same order aligns the two, and what is
    left between anchors differs. A rule names only the differing tokens (of a token
    like ``12_p0_square1200`` only the differing word; number tokens stay whole), so one
    pair serves all addresses of its kind. Equal, empty and null addresses give no rule.
    ``pairs``: seq (one row each), thumb, original. ``literal`` is a word that every
    address a rule applies to holds.
    """
    p = pairs.select("seq", F.trim("thumb").alias("thumb"), F.trim("original").alias("original"))
    p = p.where((F.col("thumb") != "") & (F.col("original") != "") & (F.col("thumb") != F.col("original")))
    tokens = lambda c: F.regexp_extract_all(c, F.lit(_TOKEN), 1)
    none = F.array().cast("array<struct<i:int,j:int>>")
    begin = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"))

    def marked(s: Column) -> Column:
        end = F.struct(F.size(s["a"]).alias("i"), F.size(s["b"]).alias("j"))
        return let(F.struct(s["a"].alias("a"), s["b"].alias("b"), F.concat(F.array(begin), _rising(s["anchors"]), F.array(end)).alias("marks")), changed)

    def changed(s: Column) -> Column:
        gap = lambda k: _gap(s["a"], s["b"], F.get(s["marks"], k), F.get(s["marks"], k + 1))
        return F.array_compact(F.transform(F.sequence(F.lit(0), F.size(s["marks"]) - 2), gap))

    def ruled(changes: Column) -> Column:
        return F.when((F.size(changes) > 0) & F.forall(changes, lambda c: c["old"] != ""), _rule(changes))

    # every step is bound to a name and the rule exploded: as columns, Spark would work them out again at every place that reads them
    sides = F.struct(tokens("thumb").alias("a"), tokens("original").alias("b"), F.coalesce("anchors", none).alias("anchors"))
    rule = let(let(sides, marked), ruled)
    d = p.join(_anchors(p), "seq", "left").select("seq", F.explode(F.array_compact(F.array(rule))).alias("r"))
    g = d.groupBy("r.pattern", "r.replacement", "r.literal").agg(F.min("seq").alias("seq"), F.count("*").alias("pairs"))
    return g.select("pattern", "replacement", "pairs", "seq", F.lit(0).alias("pos"), "literal")


def rewrite_urls(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """*urls* with ``original`` and ``rule_seq``: rewritten by the first rule (``seq``, ``pos``) that changes the address.

    Rules are rows of :func:`derive_rewrite_rules`. Only those meet an address whose
    literal word it holds; a rule without one meets all. Unchanged addresses keep
    their text and have no ``rule_seq``.
    """
    seen = urls.select(F.col(url).alias("_u")).where(F.col("_u").isNotNull()).distinct()
    words = F.array_distinct(F.concat(F.array(F.lit("")), F.split("_u", "[^A-Za-z0-9]+")))
    met = seen.select("_u", F.explode(words).alias("_w")).join(rules, F.col("_w") == F.col("literal"))
    new = F.regexp_replace(F.col("_u"), F.col("pattern"), F.col("replacement"))
    met = met.select("_u", "seq", "pos", new.alias("new")).where((F.col("new") != F.col("_u")) & (F.col("new") != ""))
    best = met.groupBy("_u").agg(F.min(F.struct("seq", "pos", "new")).alias("_b"))
    d = urls.join(best, F.col(url) == F.col("_u"), "left")
    return d.select(*[F.col(f"`{c}`") for c in urls.columns], F.coalesce("_b.new", url).alias("original"), F.col("_b.seq").alias("rule_seq"))


def rewrite_rules_from_text(spark: SparkSession, text: str) -> DataFrame:
    """Rules from a setting: rule JSON (object or list) or lines ``thumb|original``."""
    text = text.strip()
    raw: list = []
    if text:
        try:
            parsed = json.loads(text)
            raw = parsed if isinstance(parsed, list) else [parsed]
        except json.JSONDecodeError:
            raw = [line for line in text.splitlines() if line.strip()]
    rows, pairs = [], []
    for i, entry in enumerate(raw):
        if isinstance(entry, dict) and str(entry.get("pattern") or "").strip() and entry.get("enabled", True):
            rows.append((i, 0, str(entry["pattern"]), str(entry.get("replacement") or "")))
        elif isinstance(entry, str) and "|" in entry:
            pairs.append((i, *entry.split("|", 1)))
    own = spark.createDataFrame(rows, "seq int, pos int, pattern string, replacement string")
    derived = derive_rewrite_rules(spark.createDataFrame(pairs, "seq int, thumb string, original string"))
    return own.unionByName(derived.select("seq", "pos", "pattern", "replacement"))


def thumb_to_original(url, rules: Sequence[tuple[str, str]]) -> Column:
    """``struct(url, rule)`` by the first rule that changes the address (rule is its index)."""

    def apply(u: Column) -> Column:
        out = None
        for i, (pattern, replacement) in enumerate(rules):
            new = F.regexp_replace(u, pattern, replacement)
            hit = F.when((new != u) & (new != ""), F.struct(new.alias("url"), F.lit(i).alias("rule")))
            out = hit if out is None else F.coalesce(out, hit)
        same = F.struct(u.alias("url"), F.lit(None).cast("int").alias("rule"))
        return same if out is None else F.coalesce(out, same)

    return let(col_of(url), apply)


def verify_media(
    files: DataFrame, ext_for_kind: dict[str, str] | None = None, manifest: DataFrame | None = None
) -> DataFrame:
    """What is wrong with each media file, NULL when it plays.

    ``files``: path, size, content (see ``scan_media_files``). An ID3 tag longer
    than the head is followed by its declared length. Spark's file sources leave
    out files without content; give the expected paths as ``manifest`` to have
    those reported as empty.
    """
    if manifest is not None:
        files = manifest.select("path").distinct().join(files, "path", "left")
    head = F.substring("content", 1, 4096)
    tag_end = F.aggregate(
        F.array(*[F.conv(F.hex(F.substring("content", i, 1)), 16, 10).try_cast("int") for i in (7, 8, 9, 10)]),
        F.lit(0), lambda a, b: F.call_function("shiftleft", a, F.lit(7)).bitwiseOR(b.bitwiseAND(127)),
    )
    is_id3 = F.hex(F.substring("content", 1, 3)) == "494433"
    far = F.substring("content", F.lit(1), F.least(tag_end + 10 + 8192, F.lit(4 * 1024 * 1024)))
    d = files.withColumn("_head", F.when(is_id3, F.when(F.octet_length(far) > 4096, far).otherwise(head)).otherwise(head))
    d = d.withColumn("kind", sniff_kind("_head")).drop("_head")
    wanted_map = {**KIND_EXT, **(ext_for_kind or {})}
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in wanted_map.items() for x in kv]), F.col("kind"))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    fits = (
        F.when(F.col("kind") == "mp4", wanted.isin(".mp4", ".m4a"))
        .when(F.col("kind") == "matroska", wanted.isin(".webm", ".mka", ".mkv"))
        .otherwise(wanted.isin(*KIND_EXT.values(), ".mka"))
    )
    problem = (
        F.when(F.coalesce("size", F.lit(0)) == 0, "empty")
        .when(F.col("kind").isNull(), "unknown type")
        .when(~F.col("kind").isin(*PLAYABLE), F.concat(F.lit("not playable: "), "kind"))
        .when((ext != wanted) & ~fits, F.concat(F.lit("extension mismatch: "), ext))
        .when((F.col("kind") == "mp4") & ~has_moov("content"), "mp4 without moov")
    )
    return d.select(
        "path", "size", "kind", problem.alias("problem"),
        F.when(problem.isNull() & (ext != wanted), wanted).alias("rename_to"),
    )
