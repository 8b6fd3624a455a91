import json
import random

from pyspark.sql import functions as F

from webframe.functions.media import looks_like_audio
from webframe.operators import media as M
from webframe.sources.media_files import scan_media_files

BODIES = [
    ("a", "https://m.example.com/search", {"code": 200, "data": {"total": "1", "list": [{"rid": 4589227, "name": "x", "albumpic": ""}]}}),
    ("b", "https://g.example.com/gen", {"data": {"url": "https://pkgdown.example.com/9879e233/mbox/kwplayerautolite_C_APK_lite.apk"}}),
    ("c", "https://api.example.com/song/url", {"data": {
        "playUrl": "https://cdn.example.com/a/b/song.mp3?sign=abc",
        "audioUrl": "https://proxy.example.com/get?file=https%3A%2F%2Fcdn2.example.com%2Freal.flac",
        "pic": "https://cdn.example.com/cover.jpg", "lyric": "https://cdn.example.com/lrc/1.lrc"}}),
]


def test_sniffing_captures(spark):
    rows = [(i, "p", u, json.dumps(b), json.dumps(b)) for i, u, b in BODIES] + [("d", "p", "u", 'x "https://cdn.example.com/play/2.m4a" y', None)]
    caps = spark.createDataFrame(rows, "id string, page_url string, url string, body_text string, body_json string")
    got = [r["url"] for r in M.sniff_media_urls(caps).orderBy("position").collect()]
    assert "https://cdn.example.com/a/b/song.mp3?sign=abc" in got and "https://cdn2.example.com/real.flac" in got
    assert "https://cdn.example.com/play/2.m4a" in got
    assert not any(x in u for u in got for x in (".apk", ".jpg", "1.lrc", "search"))
    assert len(M.sniff_media_urls(caps, limit=1).collect()) == 1


def test_rewrite_rules_from_pairs(spark):
    pairs = spark.createDataFrame(
        [(1, "https://d.com/a/2024/04/x.thumb.400_0.jpeg", "https://d.com/a/2024/04/x.thumb.1000_0.jpeg"),
         (2, "https://i.px.net/c/250x250_80_a2/img/1_p0_square1200.jpg", "https://i.px.net/img/1_p0_master1200.jpg"), (3, "same", "same")],
        "seq int, thumb string, original string",
    )
    rules = [(r["pattern"], r["replacement"]) for r in M.derive_rewrite_rules(pairs).orderBy("seq").collect()]
    assert len(rules) == 2
    urls = spark.createDataFrame(
        [("https://d.com/b/2024/400/04/y.thumb.400_0.jpeg", "https://d.com/b/2024/400/04/y.thumb.1000_0.jpeg"),
         ("https://i.px.net/c/250x250_80_a2/img/77_p3_square1200.jpg", "https://i.px.net/img/77_p3_master1200.jpg"), ("https://z/none.png", "https://z/none.png")],
        "u string, want string",
    )
    assert all(r["want"] == r["t"]["url"] for r in urls.select("want", M.thumb_to_original("u", rules).alias("t")).collect())
    text = "a/400_0.jpg|a/1000_0.jpg\n"
    assert M.rewrite_rules_from_text(spark, text).count() == 1
    assert M.rewrite_rules_from_text(spark, '[{"pattern": "x", "replacement": "y"}, {"pattern": ""}]').count() == 1


def test_rules_lead_from_thumb_to_original(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        words = [f"{rng.choice('abcdefgh')}{k}x{rng.randint(0, 9)}" for k in range(rng.randint(2, 6))]
        other = list(words)
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(other))
            kind = rng.choice(["put", "drop", "swap"])
            if kind == "put":
                other.insert(at, f"new{rng.randint(0, 99)}q")
            elif kind == "drop" and len(other) > 1:
                del other[at]
            else:
                other[at] = f"big{rng.randint(0, 99)}q"
        rows.append((i, "https://h.example.com/" + "/".join(words), "https://h.example.com/" + "/".join(other)))
    rows += [(200, "a", "a"), (201, "", "b"), (202, None, "b"), (203, "x", "y"), (204, "https://h/a/b/", "https://h/a/c/b/")]
    pairs = spark.createDataFrame(rows, "seq int, thumb string, original string")
    rules = {r.seq: r for r in M.derive_rewrite_rules(pairs).collect()}
    assert len(rules) > 80 and not {200, 201, 202} & set(rules)
    own = spark.createDataFrame([(r.seq, r.pos, r.pattern, r.replacement, r.literal) for r in rules.values()], "seq int, pos int, pattern string, replacement string, literal string")
    for i, thumb, original in [*rows[:120:40], rows[-1]]:
        got = M.rewrite_urls(spark.createDataFrame([(thumb,), (thumb,), ("https://none.example.org/z",), (None,)], "url string"), own.where(F.col("seq") == rules[i].seq) if i in rules else own.limit(0)).collect()
        if i in rules:
            assert [r.original for r in got if r.url == thumb] == [original] * 2
        assert sorted((r.rule_seq is None for r in got if r.url != thumb)) == [True, True]


def test_files_are_verified(spark, tmp_path):
    mp4 = b"\0\0\0\x18ftypisom" + b"0" * 50
    tag = b"ID3\x04\0\0" + bytes([0, 0, 0x40, 0]) + b"0" * (0x40 << 7)
    files = {
        "ok.mp4": mp4 + b"moov" + b"1" * 9, "cut.mp4": mp4, "a.mp3": b"ID3\x04\0\0\0\0\0\x10" + b"0" * 16 + b"\xff\xfb\x90\0" + b"0" * 40,
        "big_tag.mp3": tag + b"\xff\xfb\x90\0" + b"0" * 400, "b.flac": b"fLaC\0\0\0\x22" + b"0" * 40, "img.mp3": b"\x89PNG\r\n\x1a\n" + b"0" * 30,
        "e.mp3": b"", "x.php": b"\x1a\x45\xdf\xa3" + b"0" * 30, "q.ogg": b"hello world hello",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    manifest = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in files], "path string")
    got = {
        r["path"].rsplit("/", 1)[1]: (r["problem"], r["rename_to"])
        for r in M.verify_media(scan_media_files(spark, str(tmp_path)), manifest=manifest).collect()
    }
    assert got == {
        "ok.mp4": (None, None), "cut.mp4": ("mp4 without moov", None), "a.mp3": (None, None), "big_tag.mp3": (None, None), "b.flac": (None, None),
        "img.mp3": ("not playable: png", None), "e.mp3": ("empty", None), "x.php": (None, ".webm"), "q.ogg": ("unknown type", None),
    }
    renamed = M.verify_media(scan_media_files(spark, str(tmp_path), "ok.mp4"), {"mp4": ".m4a"}).first()
    assert renamed["rename_to"] == ".m4a" and renamed["problem"] is None


def test_audio_heads(spark):
    cases = [
        (b"ID3\x04\0\0\0\0\0\0", "mp3"), (b"\xff\xfb\x90\0", "mp3"), (b"fLaC\0\0\0\x22", "flac"), (b"OggS\0\x02", "ogg"), (b"RIFF\0\0\0\0WAVE", "wav/riff"),
        (b"\0\0\0\x1cftypM4A ", "mp4/m4a"), (b"PK\x03\x04\x14\0", None), (b"<!DOCTYPE html>", None), (b'{"code":200}', None), (b"\x89PNG\r\n\x1a\n", None), (b"", None),
    ]
    d = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(cases)], "i int, b binary")
    got = {r["i"]: r["k"] for r in d.select("i", looks_like_audio("b").alias("k")).collect()}
    assert got == {i: k for i, (_, k) in enumerate(cases)}


def test_collecting_addresses(spark, page):
    from webframe.sources.nodes import html_nodes

    html = '<img src="/a.jpg" width="20"><img data-src="//c/b.jpg"><img src="/a.jpg"><img src="data:x"><source srcset="/s1.jpg 1x, /s2.jpg 2x">'
    pages = page(html, "http://h/x")
    nodes = html_nodes(pages, ["node_id", "depth", "tag", "path", "attrs", "own_text"]).cache()
    items = spark.createDataFrame([(1, 1, "/i1.jpg; /i2.mp3,"), (1, 2, "/a.jpg")], "page_id bigint, item_id int, image string")
    own = M.item_urls(items, "image").selectExpr("page_id", "item_id * 10 + pos as seq", "url")
    dom = M.dom_urls(nodes, "img").selectExpr("page_id", "node_id as seq", "url")
    got = [r["url"] for r in M.collect_media_urls([own, dom], pages).orderBy("position").collect()]
    assert got == ["http://h/i1.jpg", "http://h/i2.mp3", "http://h/a.jpg", "http://c/b.jpg"]
    assert [r["url"] for r in M.dom_urls(nodes, "source", "srcset").collect()] == ["/s1.jpg"]
    assert [r["url"] for r in M.item_urls(items, "image", (".mp3",)).collect()] == ["/i2.mp3"]
    wide = M.min_width(spark.createDataFrame([(1, "http://h/a.jpg"), (1, "http://h/zz.jpg")], "page_id bigint, url string"), M.image_sizes(nodes, pages), 50)
    assert [r["url"] for r in wide.collect()] == ["http://h/zz.jpg"]
    assert [r["url"] for r in M.pattern_urls(spark.createDataFrame([(1, '{"a":"https://x/1.pdf","b":"https://x/2.png"}')], "id int, data string"), r"\.pdf$").collect()] == ["https://x/1.pdf"]


def test_rewrite_rules_align_each_pair_once(spark):
    pairs = spark.createDataFrame([(1, "http://h/small/i1.png", "http://h/large/i1.png")], "seq int, thumb string, original string")
    rules = M.derive_rewrite_rules(pairs)
    assert [(r["replacement"], r["pairs"]) for r in rules.collect()] == [("large", 1)]
    # as columns the alignment was worked out again wherever it was read
    assert len(rules._jdf.queryExecution().optimizedPlan().toString()) < 20000
