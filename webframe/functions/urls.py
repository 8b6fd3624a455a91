"""URL functions as Columns. URLs are split with one RFC 3986 pattern, because
``parse_url`` rejects the many real-world URLs that are not valid URIs."""

from __future__ import annotations

import mimetypes
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webframe.functions.common import col_of, let

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
_SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?"

# Field names that hold links.
URLISH_FIELD = (
    r"(?i)(?:^|_)(?:href|url|uri|link|src|source|image|img|thumb|thumbnail|photo|audio|video|"
    r"avatar|cover|download)(?:$|_)"
)
STREAM_SUFFIXES = (".m3u8", ".mpd")
INNER_URL_PARAMS = (
    "file", "url", "u", "src", "source", "target", "link", "href", "download", "path", "proxy", "redirect",
)
# Content types whose extension differs from, or is missing in, the standard table.
EXTRA_TYPES = {
    "image/jpeg": ".jpg",
    "image/jpg": ".jpg",
    "image/png": ".png",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "image/svg+xml": ".svg",
    "image/avif": ".avif",
    "image/bmp": ".bmp",
    "image/x-icon": ".ico",
    "audio/mpeg": ".mp3",
    "audio/mp3": ".mp3",
    "audio/mp4": ".m4a",
    "audio/aac": ".aac",
    "audio/flac": ".flac",
    "audio/x-flac": ".flac",
    "audio/ogg": ".ogg",
    "audio/wav": ".wav",
    "audio/x-wav": ".wav",
    "audio/webm": ".weba",
    "application/pdf": ".pdf",
    "video/mp4": ".mp4",
}
TRANSIENT_ERROR = (
    r"(?i)timeout|timed out|超时|connect|connection|reset|refused|unreachable|"
    r"Temporary failure|502|503|504|429|too many requests"
)
PERMANENT_WORDS = ("类型不符", "完整性校验", "超过大小上限")


def url_part(c, part: str) -> Column:
    """``scheme``, ``netloc``, ``path``, ``query`` or ``fragment`` ('' when missing)."""
    group = {"scheme": 1, "netloc": 2, "path": 3, "query": 4, "fragment": 5}[part]
    return F.regexp_extract(F.coalesce(col_of(c), F.lit("")), _SPLIT, group)


def hostname(c) -> Column:
    """Lower-case host without user info and port ('' when missing)."""
    host = F.regexp_replace(url_part(c, "netloc"), "^.*@", "")
    return F.lower(F.regexp_replace(host, r":\d*$", ""))


def url_host(c) -> Column:
    """The authority for display; the URL itself when it has none."""
    c = F.coalesce(col_of(c), F.lit(""))
    net = url_part(c, "netloc")
    return F.when(net == "", c).otherwise(net)


def _clean_path(path: Column, rooted: Column) -> Column:
    """Apply dot segments; empty segments are only dropped from merged (not rooted) paths."""
    segs = F.split(path, "/")
    n = F.size(segs)
    inner = F.filter(F.slice(segs, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda s: rooted | (s != ""))
    last = F.element_at(segs, -1)
    walk = F.when(n > 1, F.concat(F.slice(segs, 1, 1), inner, F.array(last))).otherwise(segs)
    done = F.aggregate(
        walk,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    closed = F.when(last.isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done)
    out = F.array_join(closed, "/")
    return F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


_ROOT = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)"


def _resolve(base: Column, rel: Column) -> Column:
    root = F.regexp_extract(base, _ROOT, 1)
    folder = F.regexp_extract(base, _ROOT + r"(/(?:[^?#]*/)?)", 2)
    folder = F.when(folder == "", "/").otherwise(folder)
    path = F.regexp_extract(rel, r"^([^?#]*)", 1)
    rest = F.regexp_extract(rel, r"^[^?#]*([\s\S]*)$", 1)
    rooted = rel.startswith("/")
    return (
        F.when(base == "", rel)
        .when(rel == "", base)
        .when(rel.rlike(_SCHEME), rel)
        .when(rel.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]*:)", 1), rel))
        .when(rel.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), rel))
        .when(rel.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), rel))
        .when(rooted & ~path.rlike(r"/\.\.?(/|$)"), F.concat(root, rel))
        .when(~rooted & ~path.rlike(r"(^|/)\.\.?(/|$)|//"), F.concat(root, folder, rel))
        .otherwise(
            F.concat(
                root,
                let(
                    F.when(rooted, path).otherwise(F.concat(folder, path)),
                    lambda p: _clean_path(p, rooted),
                ),
                rest,
            )
        )
    )


def resolve_url(base, rel) -> Column:
    """Join *rel* to *base* by RFC 3986; dot segments cost work only where they occur."""
    pair = F.struct(F.coalesce(col_of(base), F.lit("")).alias("b"), col_of(rel).alias("r"))
    return let(pair, lambda s: _resolve(s["b"], s["r"]))


def is_link_name(name: str) -> bool:
    return re.search(URLISH_FIELD, name) is not None


def is_link_name_column(name) -> Column:
    """The same for names that are data."""
    return F.coalesce(col_of(name).rlike(URLISH_FIELD), F.lit(False))


def absolutize(value, base) -> Column:
    """Site-relative values (exactly one leading '/') become absolute; all else is kept."""
    pair = F.struct(F.coalesce(col_of(base), F.lit("")).alias("b"), col_of(value).alias("v"))

    def fix(s: Column) -> Column:
        v = F.trim(s["v"])
        local = v.startswith("/") & ~v.startswith("//") & (s["b"] != "")
        return F.when(local, _resolve(s["b"], v)).otherwise(s["v"])

    return let(pair, fix)


def absolute_media_url(base, candidate) -> Column:
    pair = F.struct(
        F.coalesce(col_of(base), F.lit("")).alias("b"),
        F.trim(F.coalesce(col_of(candidate), F.lit(""))).alias("c"),
    )

    def fix(s: Column) -> Column:
        c, scheme = s["c"], url_part(s["b"], "scheme")
        return (
            F.when((c == "") | c.startswith("data:"), "")
            .when(c.rlike("^https?://"), c)
            .when(c.startswith("//"), F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit(":"), c))
            .otherwise(_resolve(s["b"], c))
        )

    return let(pair, fix)


def url_slug(c) -> Column:
    """Folder name of a URL: host, path and a short digest of the query."""
    c = F.coalesce(col_of(c), F.lit(""))
    net, query = url_part(c, "netloc"), url_part(c, "query")
    raw = F.concat(
        F.when(net == "", "site").otherwise(net),
        F.translate(url_part(c, "path"), "/", "_"),
        F.when(query != "", F.concat(F.lit("_"), F.substring(F.sha1(query), 1, 6))).otherwise(""),
    )
    slug = F.regexp_replace(raw, r"[^\p{L}\p{N}._\-]", "_")
    slug = F.regexp_replace(slug, r"^[._\-]+|[._\-]+$", "")
    slug = F.when(slug == "", "site").otherwise(slug)
    # a longer one keeps its URLs apart by a digest; the length fits any file system
    return F.when(c == "", "_no_url").when(F.length(slug) <= 80, slug).otherwise(
        F.concat(F.substring(slug, 1, 69), F.lit("_"), F.substring(F.sha1(raw), 1, 10))
    )


def site_slug(c) -> Column:
    host = hostname(c)
    return F.regexp_replace(F.when(host == "", "unknown").otherwise(host), r"[^A-Za-z0-9._-]", "_")


def is_stream_url(c) -> Column:
    path = F.lower(url_part(c, "path"))
    return path.endswith(STREAM_SUFFIXES[0]) | path.endswith(STREAM_SUFFIXES[1])


def safe_filename(url, fallback_ext: str = ".bin") -> Column:
    url = col_of(url)
    name = F.element_at(F.split(F.regexp_replace(url_part(url, "path"), "/+$", ""), "/"), -1)
    name = F.regexp_replace(name, r"(?U)[^\w.\-]+", "_")
    name = F.regexp_replace(name, r"^[._]+|[._]+$", "")

    def build(n: Column) -> Column:
        digest = F.substring(F.md5(url), 1, 10)
        ext = F.regexp_extract(n, r".(\.[A-Za-z0-9]{1,5})$", 1)
        stem = F.substring(n, F.lit(1), F.least(F.lit(60), F.length(n) - F.length(ext)))
        return (
            F.when(n == "", F.concat(digest, F.lit(fallback_ext)))
            .when(ext != "", F.concat(stem, F.lit("_"), digest, F.lower(ext)))
            .otherwise(F.concat(F.substring(n, 1, 60), F.lit("_"), digest, F.lit(fallback_ext)))
        )

    return let(name, build)


def guess_extension(content_type, url, default: str = ".bin") -> Column:
    """Extension by content type, then by URL suffix, then *default*."""
    known = mimetypes.MimeTypes()  # Python's own table, without the files of this machine
    table = {t: known.guess_extension(t) for t in set(known.types_map[True].values())}
    table = {t: (".jpg" if e == ".jpe" else e) for t, e in table.items() if e}
    table.update(EXTRA_TYPES)
    lookup = F.create_map(*[F.lit(x) for t in sorted(table) for x in (t, table[t])])
    kind = F.lower(F.trim(F.split_part(F.coalesce(col_of(content_type), F.lit("")), F.lit(";"), F.lit(1))))
    suffix = F.lower(F.regexp_extract(url_part(url, "path"), r"[^/](\.[A-Za-z0-9]{1,5})$", 1))
    return F.coalesce(F.try_element_at(lookup, kind), F.nullif(suffix, F.lit("")), F.lit(default))


def safe_name(c, limit: int = 80) -> Column:
    t = F.regexp_replace(F.trim(F.coalesce(col_of(c), F.lit(""))), r"[\\/:*?\"<>|\r\n\t]", "_")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ .]+|[ .]+$", "")
    return F.substring(t, 1, limit)


def _decode(c: Column, plus_is_space: bool) -> Column:
    src = c if plus_is_space else F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(src), c)


def inner_urls(c) -> Column:
    """http(s) URLs carried in the known query parameters, by parameter order."""
    names = F.array(*[F.lit(n) for n in INNER_URL_PARAMS])

    def unpack(u: Column) -> Column:
        pairs = F.transform(
            F.split(url_part(u, "query"), "&"),
            lambda p, i: F.struct(
                F.array_position(names, F.split_part(p, F.lit("="), F.lit(1))).alias("at"), i.alias("i"), p.alias("p")
            ),
        )
        known = F.array_sort(F.filter(pairs, lambda p: (p["at"] > 0) & p["p"].contains("=")))
        values = F.transform(
            known, lambda p: _decode(_decode(F.substring(p["p"], F.instr(p["p"], F.lit("=")) + 1, F.length(p["p"])), True), False)
        )
        return F.filter(values, lambda v: v.rlike("^https?://") & (v != u))

    return let(
        F.coalesce(col_of(c), F.lit("")),
        lambda u: F.when(u.contains("="), unpack(u)).otherwise(F.array().cast("array<string>")),
    )


def url_changed(requested, final) -> Column:
    """``struct(changed, kind)``; kind is none, fragment, cross-site or path."""
    a, b = F.coalesce(col_of(requested), F.lit("")), F.coalesce(col_of(final), F.lit(""))
    base = lambda u: F.regexp_replace(F.split_part(u, F.lit("#"), F.lit(1)), "/+$", "")
    site = lambda u: F.regexp_replace(hostname(u), r"^www\.", "")
    kind = (
        F.when((a == "") | (b == ""), "none")
        .when(
            base(a) == base(b),
            F.when(url_part(a, "fragment") != url_part(b, "fragment"), "fragment").otherwise("none"),
        )
        .when((site(a) == "") | (site(a) != site(b)), "cross-site")
        .otherwise("path")
    )
    return F.struct(kind.isin("cross-site", "path").alias("changed"), kind.alias("kind"))


def song_id(c) -> Column:
    c = F.coalesce(col_of(c), F.lit(""))
    direct = F.regexp_extract(c, r"(?i)(?:^|[/?#&])song(?:\.php)?(?:/|\?|#|$)[^0-9]{0,12}(\d{2,})", 1)
    by_query = F.regexp_extract(c, r"[?&#]id=(\d{2,})", 1)
    return F.when(direct != "", direct).when(F.lower(c).contains("/song"), by_query).otherwise("")


def url_fragments(c) -> Column:
    """URL-like pieces of mixed text in order, or the text itself."""
    c = F.coalesce(col_of(c), F.lit(""))
    hits = F.array_distinct(F.regexp_extract_all(c, F.lit(r"https?://[^\s]+|/[A-Za-z0-9_\-./?=&%#]+"), 0))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.trim(c)))


def is_transient_error(c) -> Column:
    c = F.coalesce(col_of(c), F.lit(""))
    permanent = c.rlike(r"\b40[0-9]\b") & ~c.rlike(r"\b429\b")
    for word in PERMANENT_WORDS:
        permanent = permanent | c.contains(word)
    return (c != "") & ~permanent & c.rlike(TRANSIENT_ERROR)
