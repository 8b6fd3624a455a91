from urllib.parse import urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webframe.functions import text as T
from webframe.functions import urls as U
from webframe.functions.jsonpath import flatten_json, jsonpath
from webframe.functions.matching import found, needed_literals, prepared
from webframe.operators.diagnose import BLOCK_PATTERNS, KEYWORDS


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


def texts(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "t string").coalesce(1)


def test_resolve_url_like_the_standard_join(spark):
    bases = ["http://a.com/b/c/d?q=1#f", "https://x.org", "https://x.org/", "http://a.com/b/c/"]
    rels = ["/x", "y", "../y", "../../../z", "./", "..", "?p=2", "#t", "//cdn/x", "http://o/p", "", "a/./b/../c?k=/../", "g;x=1", "/a//b", "mailto:x@y", "a//b"]
    d = spark.createDataFrame([(b, r) for b in bases for r in rels], "b string, r string").coalesce(1)
    for row in d.select("b", "r", U.resolve_url("b", "r").alias("o")).collect():
        assert row["o"] == urljoin(row["b"], row["r"]), row


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["", "/", "./", "../"]), st.lists(st.sampled_from(["a", "b", "..", ".", "c.html"]), max_size=4)), min_size=1, max_size=20))
def test_resolve_url_property(spark, parts):
    rels = [p + "/".join(s) for p, s in parts]
    base = "http://h.example.com/one/two/three.html"
    d = spark.createDataFrame([(r,) for r in rels], "r string").coalesce(1)
    for row in d.select("r", U.resolve_url(F.lit(base), "r").alias("o")).collect():
        assert row["o"] == urljoin(base, row["r"]), row


def test_dates(spark):
    want = {
        "2024-1-2": "2024-01-02", "2024/01/02": "2024-01-02", "2024年1月2日": "2024-01-02", "3/4/2024": "2024-03-04", "13-12-2023": "2023-12-13",
        "2024-01-02 03:04:05": "2024-01-02", "2024-01-02T03:04:05Z": "2024-01-02T03:04:05+00:00", "hello": "hello", "2024-13-01": "2024-13-01",
    }
    d = texts(spark, *want)
    assert dict((r[0], r[1]) for r in d.select("t", T.to_date_text("t")).collect()) == want


def test_numbers_and_text(spark):
    d = texts(spark, "　£1,234.50 x -7 ")
    assert d.select(T.to_int("t"), T.to_float("t"), T.to_price("t"), T.strip("t")).first() == (1234, 1234.5, 1234.5, "£1,234.50 x -7")
    d = texts(spark, "background-image: url('/a.jpg')", "/s.jpg 1x, /b.jpg 2x", "url()", " b ")
    assert values(d, T.to_url("t", F.lit("http://h/p/q"))) == ["http://h/a.jpg", "http://h/s.jpg", "url()", "http://h/p/b"]


def test_counts_in_goals(spark):
    want = {"first 3 images": 3, "爬取前三张": 3, "最多十五首": 15, "二十张图": 20, "top: 7": 7, "nothing": None, "三十二个": 32}
    d = texts(spark, *want)
    assert dict((r[0], r[1]) for r in d.select("t", T.parse_count("t")).collect()) == want


def test_json_block(spark):
    d = texts(spark, 'x ```json {"a":1} ``` y', "[1,2]", 'foo {"a":"}"} bar', "no", "bad {a} then [3]", None)
    assert values(d, T.json_block("t")) == ['{"a":1}', "[1,2]", '{"a":"}"}', None, "[3]", None]


def test_coerce(spark):
    d = texts(spark, " Yes ", "off", "是")
    assert values(d, T.coerce("t", "bool")) == [True, False, True]
    d = texts(spark, "[1,3]", "a, 'b'\nc", "")
    assert values(d, T.coerce("t", "list")) == [["1", "3"], ["a", "b", "c"], []]
    d = texts(spark, "7.9", "x")
    assert values(d, T.coerce("t", "int")) == [7, None]


def test_masks_codes_and_truncation(spark):
    d = texts(spark, "error_code: AUTH_4031 request_id: 7f3a9c2e-11b4 code: 4031 1234567890123")
    assert values(d, T.extract_codes("t"))[0] == {"error_code": "AUTH_4031", "code": "4031", "request_id": "7f3a9c2e-11b4", "timestamp_like": "1234567890123"}
    assert values(texts(spark, "sk-123456789", "short"), T.mask_secret("t")) == ["sk-1********6789", "*****"]
    assert values(texts(spark, "http://u:p@h:80/x", "h:1"), T.mask_proxy("t")) == ["http://***@h:80/x", "h:1"]
    cut = values(texts(spark, "a" * 50 + "b" * 50), T.truncate_middle("t", 60))[0]
    assert len(cut) == 60 and cut.startswith("a") and cut.endswith("b") and " 40 " in cut
    assert values(texts(spark, "x" * 79, " y" * 80), T.looks_like_spa_shell("t", F.lit(0), F.lit(99))) == [True, False]


def test_hash_ignores_order_and_keeps_nulls(spark):
    d = spark.createDataFrame([(1, None), (None, 1)], "a int, b int").coalesce(1)
    h = values(d, T.stable_hash("a", "b"))
    assert h == values(d, T.stable_hash("b", "a")) and h[0] != h[1]


def test_url_helpers(spark):
    d = texts(spark, "https://p.example.com/get?x=1&file=https%3A%2F%2Fc2.example.com%2Freal.flac")
    assert values(d, U.inner_urls("t")) == [["https://c2.example.com/real.flac"]]
    d = texts(spark, "https://www.x.com/search/?kw=1", "", "https://x.com/a.tar.gz")
    slugs = values(d, U.url_slug("t"))
    assert slugs[0].startswith("www.x.com_search_") and slugs[1] == "_no_url" and slugs[2] == "x.com_a.tar.gz"
    names = values(d, U.safe_filename("t"))
    assert names[2].startswith("a.tar_") and names[2].endswith(".gz") and names[0].startswith("search_")
    d = spark.createDataFrame(
        [("http://a/x", "http://a/x#s", "fragment"), ("http://a/x", "http://a/x/", "none"), ("http://a/x", "http://www.a/y", "path"), ("http://a/x", "http://b/x", "cross-site"), ("", "http://b", "none")],
        "a string, b string, want string",
    )
    assert all(r["want"] == r["k"]["kind"] for r in d.select("want", U.url_changed("a", "b").alias("k")).collect())
    d = texts(spark, "HTTP 503 timeout", "HTTP 403", "ok", "429 too many requests", "")
    assert values(d, U.is_transient_error("t")) == [True, False, False, True, False]
    assert values(texts(spark, "https://m/song?id=123", "https://m/song/77", "x"), U.song_id("t")) == ["123", "77", ""]
    assert values(texts(spark, "Name\nhttps://a/b\n/song?id=2 http"), U.url_fragments("t")) == [["https://a/b", "/song?id=2"]]
    got = d.sparkSession.range(1).select(U.guess_extension(F.lit("image/jpeg; q=1"), F.lit("")), U.guess_extension(F.lit(""), F.lit("http://x/a.MP3?x")), U.guess_extension(F.lit(""), F.lit("http://x/a"))).first()
    assert tuple(got) == (".jpg", ".mp3", ".bin")


def test_jsonpath(spark):
    j = '{"data":{"list":[{"a":1,"b":{"c":"x"}},{"a":2,"p":[1,2,3]}],"o":{"k1":{"a":5},"k2":{"a":6}}},"s":["q","w"]}'
    d = texts(spark, j)
    want = {
        "$.data.list[*].a": ["1", "2"], "$.data.o[*].a": ["5", "6"], "$..a": ["1", "2", "5", "6"], "$.data.list[-1].p[-1]": ["3"], "$.data.list[-5]": [],
        "$['s'][1]": ["w"], "$.s[*]": ["q", "w"], "$..list[*].b.c": ["x"], "$.none.x": [], "s": ['["q","w"]'],
    }
    for path, expect in want.items():
        assert values(d, jsonpath("t", path))[0] == expect, path
    leaves = values(d, flatten_json("t"))[0]
    assert ("data.list[1].p[2]", "3") in {(x["path"], x["value"]) for x in leaves}
    flat = values(texts(spark, '{"a":{"b":[1]},"c":2}'), flatten_json("t", list_items=False))[0]
    assert [(x["path"], x["value"]) for x in flat] == [("a.b", "[1]"), ("c", "2")]


def test_literal_prefilter_never_loses_a_match(spark):
    samples = [
        "PERMISSION  denied", "Login Required", "请先登录", "500 Internal Server Error", "HTTP 502", "No Results found", "ſign in pleaſe sIgn in", "只有管理员才能查看",
        "your search for x did not match", "nothing here", "Blocked by firewall", "您的IP地址已被限制", "cf_chl_opt", "未找到相关结果", "İnternal server error",
    ]
    d = texts(spark, *samples).withColumn("p", prepared(F.col("t")))
    for pattern in [k[0] for k in KEYWORDS] + [b[0] for b in BLOCK_PATTERNS]:
        both = d.select(found(F.col("p"), pattern).alias("fast"), F.col("t").rlike("(?iuU)" + pattern).alias("slow"), "t").collect()
        assert all(r["fast"] == r["slow"] for r in both), (pattern, needed_literals(pattern), both)
