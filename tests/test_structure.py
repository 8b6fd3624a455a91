from pyspark.sql import functions as F

from webframe.operators import structure as D
from webframe.operators.extract import extract_dom, finish_rows
from webframe.operators.rules import Field, Rule, rule_from_row
from webframe.operators.selectors import select_nodes
from webframe.sources.nodes import html_nodes


def masonry(per_column=8):
    cards, n = [], 0
    for col in range(3):
        for _ in range(per_column):
            n += 1
            cards.append(
                f'<div class="woo co{col}"><a class="a" href="/detail/{n}"><img src="/img/{n}.jpg"></a>'
                f'<span class="title">Picture title {n}</span></div>'
            )
    return "<html><body><div class='woo-pcont'>" + "\n".join(cards) + "</div></body></html>"


KV = "<html><body><div id='box'>" + "".join(
    f'<div><div class="info_key">Key number {i}</div>'
    + (f'<a class="n-a no-underline info_value" href="/x/{i}">Value {i}</a>' if i == 0 else f'<div class="info_value">Value {i}</div>')
    + "</div>"
    for i in range(8)
) + "</div></body></html>"

CARDS = "<html><body><section class='list'>" + "".join(
    f'<article class="product_pod"><div class="pic"><img src="/i/{i}.jpg"></div><h3><a href="/b/{i}.html" title="Book {i}">Book title {i}</a></h3>'
    f'<p class="price_color">£{i + 10}.50</p><p class="instock availability">In stock</p></article>'
    for i in range(5)
) + "</section><footer><ul><li><a href='/about'>About</a></li></ul></footer></body></html>"


def nodes_of(page, html):
    return html_nodes(page(html), D.NODE_COLUMNS, carry=("url",)).cache()


def test_masonry_columns_become_one_list(page):
    nodes = nodes_of(page, masonry())
    cands = D.list_candidates(nodes, merge=True)
    rows = cands.collect()
    assert [(r["count"], r["rank"]) for r in rows] == [(24, 1)]
    assert rows[0]["item_selector"] == "div.woo-pcont > div"
    split = D.list_candidates(nodes).collect()
    assert sorted(r["count"] for r in split) == [8, 8, 8]
    fields = D.infer_fields(cands, nodes).orderBy("pos").collect()
    names = [f["name"] for f in fields]
    assert "image" in names and "link" in names


def test_unique_selector_hits_exactly_its_element(page):
    html = {
        1: masonry(3), 2: KV, 3: CARDS,
        4: "<div id='a'><p>x</p><p>y</p></div><div id='a'><p>z</p><b data-k='q'>1</b><b data-k='r'>2</b></div><p class='lead'>w</p><i id='1x'>n</i>",
    }
    nodes = nodes_of(page, html)
    sel = D.unique_selector(nodes, nodes.where("tag not in ('html','head')")).collect()
    want = {(r["page_id"], r["node_id"]): r["selector"] for r in sel}
    assert len(want) == nodes.where("tag not in ('html','head')").count()
    by_sel = {}
    for key, s in want.items():
        by_sel.setdefault(s, set()).add(key)
    cols = [D.F.lit(True)]
    from webframe.operators.selectors import match

    flags = [match(s).alias(f"s{i}") for i, s in enumerate(by_sel)]
    for chunk in range(0, len(flags), 60):
        part = flags[chunk:chunk + 60]
        got = nodes.select("page_id", "node_id", *part).collect()
        for i, s in enumerate(list(by_sel)[chunk:chunk + 60]):
            for pid in {k[0] for k in by_sel[s]}:
                hit = {(r["page_id"], r["node_id"]) for r in got if r[f"s{chunk + i}"] and r["page_id"] == pid}
                assert hit == {k for k in by_sel[s] if k[0] == pid}, (s, hit)
    assert cols
    assert want[(4, [r["node_id"] for r in sel if r["page_id"] == 4 and r["selector"].startswith("b[")][0])].startswith("b[data-k=")


def test_relative_selectors_and_rule_give_every_row(page):
    nodes = nodes_of(page, CARDS)
    cands = D.list_candidates(nodes)
    fields = D.infer_fields(cands, nodes)
    got = {r["name"]: (r["selector"], r["attribute"]) for r in fields.where("rank = 1").collect()}
    assert got["image"] == ("img", "src")
    assert got["title"] == ("a", None)
    assert got["link"] == ("a", "href")
    assert got["price"] == ("p.price_color", None)
    rules = D.build_rules(D.with_fields(cands, fields))
    row = rules.collect()[0]
    rule = rule_from_row({**row.asDict(recursive=True), "notes": ""})
    out = finish_rows(extract_dom(nodes, rule, ("url",)), rule).orderBy("item_id").collect()
    assert len(out) == row["count"] == 5
    assert out[0]["price"] == 10.5 and out[0]["link"] == "http://shop.example.com/b/0.html"


def test_key_value_rows_are_fully_covered(page):
    nodes = nodes_of(page, KV)
    cands = D.list_candidates(nodes).where("rank = 1")
    assert cands.collect()[0]["count"] == 8
    fields = D.infer_fields(cands, nodes)
    fixed = D.fix_field_coverage(fields, cands, nodes).collect()
    value = [f for f in fixed if f["name"] == "info_value"]
    assert value, fixed
    sel = value[0]["selector"]
    rule = Rule(cands.collect()[0]["item_selector"], (Field("v", sel),))
    rows = extract_dom(nodes, rule).collect()
    assert len(rows) == 8 and all(r["v"] for r in rows), (sel, rows)


def test_scope_limits_candidates(page):
    html = (
        "<html><body><ul class='menu'>" + "<li><a href='/m'>m</a></li>" * 4 + "</ul>"
        "<div class='box'><ul class='songs'>" + "".join(f"<li class='song'><a href='/s{i}'>song {i}</a></li>" for i in range(6))
        + "</ul></div><p class='none'>text</p></body></html>"
    )
    nodes = nodes_of(page, html)
    count = lambda scope: [(r["item_selector"], r["count"]) for r in D.list_candidates(nodes, scope).orderBy("rank").collect()]
    assert len(count(None)) == 2
    assert [c for _, c in count("div.box")] == [6]
    assert [c for _, c in count("ul.songs")] == [6]
    assert [c for _, c in count("li.song")] == [6]
    assert count("p.none") == []
    assert len(count("#missing")) == 2


def test_names_and_judgements(spark):
    d = spark.createDataFrame(
        [("s-fc7", True), ("u-icn2", True), ("title", False), ("artist", False), ("css-1x2", True), ("bdVaJa", True), ("price", False)],
        "n string, g boolean",
    )
    assert all(r["g"] == r["x"] for r in d.select("*", D.looks_generated("n").alias("x")).collect())
    d = spark.createDataFrame([("s_fc7", True), ("td", True), ("artist", False), ("title", False), ("bdVaJaXy", True)], "n string, g boolean")
    assert all(r["g"] == r["x"] for r in d.select("*", D.looks_generated_name("n").alias("x")).collect())
    f = spark.createDataFrame(
        [(1, 1, 1, "album", "a.x", None), (1, 1, 2, "s-fc7", "a.x", None), (1, 1, 3, "u-b2", "b", None)],
        "page_id bigint, rank int, pos int, name string, selector string, attribute string",
    )
    assert sorted(r["name"] for r in D.drop_redundant_fields(f).collect()) == ["album", "u-b2"]
    assert sorted(r["name"] for r in D.drop_generated_fields(f).collect()) == ["album"]
    s = spark.createDataFrame(
        [("/artist?id=1", "Bob", "", "artist"), ("", "03:45", "", "duration"), ("", "2024-01-02", "", "date"), ("", "plain", "zz", "fb")],
        "h string, t string, c string, want string",
    )
    assert all(r["want"] == r["x"] for r in s.select("*", D.semantic_name("h", "t", "c", F.lit("fb")).alias("x")).collect())
    c = spark.createDataFrame(
        [("nav > ul > li", "nav > ul", 20, False), ("div.card", "div", 3, True), ("div > p", "div", 9, True), ("div > p", "div", 3, False)],
        "i string, c string, n int, want boolean",
    )
    assert all(r["want"] == r["x"] for r in c.select("*", D.looks_like_data("i", "c", "n").alias("x")).collect())


def test_css_and_xpath_agree(page):
    nodes = nodes_of(page, CARDS)
    ids = lambda s: sorted(r["node_id"] for r in select_nodes(nodes, s).collect())
    assert ids("article h3 > a") == ids("//article/h3/a") != []
    assert ids("article:nth-of-type(2) p.price_color") == ids("//article[2]/p[1]")
    assert ids('section[class="list"] article img[src$=".jpg"]') == ids("//img[contains(@src,'.jpg')]")


def test_images_without_address_are_no_content(page):
    html = "<ul>" + "<li><img></li>" * 3 + "</ul><ol>" + "<li><img src=/a.png></li>" * 3 + "</ol>"
    got = D.list_candidates(nodes_of(page, html)).collect()
    assert len(got) == 1 and got[0]["item_selector"].startswith("ol")


def test_rules_keep_fields_of_equal_name(spark):
    f = "array<struct<name:string,selector:string,attribute:string>>"
    fields = [(n, f"s{i}", None) for i, n in enumerate(["title", "name", "Preis", "text", *[f"c{k}" for k in range(9)]])]
    cands = spark.createDataFrame([(1, 1, "li", "ul", 5, fields)], f"page_id bigint, rank int, item_selector string, container_selector string, count int, fields {f}")
    names = [x["name"] for x in D.build_rules(cands).collect()[0]["list_rule"]["fields"]]
    assert names == ["title", "title_2", "preis", "title_3", *[f"c{k}" for k in range(9)]]
    assert len(D.build_rules(cands, field_limit=2).collect()[0]["list_rule"]["fields"]) == 2


def menus_before_list(menus=13, levels=15):
    menu = lambda k: f"<ul class='m{k}'>" + "".join(f"<li><a href='/m{k}/{i}'>menu {k} entry</a></li>" for i in range(3)) + "</ul>"
    row = lambda i: (
        f"<div class='row'><a href='/r/{i}'>Row number {i}</a>" + "".join(f"<em class='f{k}'>field {k} of {i}</em>" for k in range(14))
        + "".join(f"<div class='l{k}'>" for k in range(levels)) + f"<b class='low'>low {i}</b>" + "</div>" * levels + "</div>"
    )
    return "<html><body>" + "".join(map(menu, range(menus))) + "<section class='main'>" + "".join(map(row, range(9))) + "</section></body></html>"


def test_list_behind_many_menus_is_found_with_all_its_fields(page):
    nodes = nodes_of(page, menus_before_list())
    cands = D.list_candidates(nodes).cache()
    rows = {r["rank"]: (r["item_selector"], r["count"]) for r in cands.collect()}
    assert rows[1] == ("section.main > div.row", 9) and len(rows) == 14
    fields = D.infer_fields(cands.where("rank = 1"), nodes).collect()
    assert {f"f{k}" for k in range(14)} <= {f["name"] for f in fields}
    assert any(f["selector"].rsplit(".", 1)[-1] in ("low", "l14", "l13", "l12", "l11") for f in fields)
    rule = D.build_rules(D.with_fields(cands, D.infer_fields(cands, nodes))).collect()[0]
    assert rule["list_rule"]["item_selector"] == "section.main > div.row"
    assert D.page_has_content(cands, nodes.groupBy("page_id").agg(F.lit(0).alias("links"), F.lit(0).alias("images"))).collect()[0]["has_content"]


def test_limits_are_asked_for(page):
    nodes = nodes_of(page, menus_before_list())
    cands = D.list_candidates(nodes, limit=3)
    assert sorted((r["rank"], r["count"]) for r in cands.collect()) == [(1, 9), (2, 3), (3, 3)]
    assert D.list_candidates(nodes, merge=True, limit=1).count() == 1
    assert [f["pos"] for f in D.infer_fields(cands.where("rank = 1"), nodes, limit=4).orderBy("pos").collect()] == [1, 2, 3, 4]


def test_uniqueness_inside_an_item_deeper_than_twelve_levels(page):
    deep = "<div class='s'>" * 14 + "<b class='x'>one {0}</b>" + "</div>" * 14
    row = lambda i: f"<li><p class='t'>Title of {i}</p>{deep.format(i)}<div class='q'>{deep.format(i)}</div></li>"
    nodes = nodes_of(page, "<html><body><ul>" + "".join(map(row, range(4))) + "</ul></body></html>")
    cands = D.list_candidates(nodes).where("rank = 1")
    found = [f["selector"] for f in D.infer_fields(cands, nodes).collect() if f["selector"].endswith("b.x")]
    assert any(s.startswith("div.q") for s in found)


def test_uniqueness_of_a_leaf_that_keeps_its_place_deeper_than_twelve_levels(page):
    """Wrappers without class, id and title are no places to move up to."""
    deep = "<div>" * 14 + "<b class='x'>one {0}</b>" + "</div>" * 14
    row = lambda i: f"<li><p class='t'>Title of {i}</p>{deep.format(i)}<div class='q'>{deep.format(i)}</div></li>"
    nodes = nodes_of(page, "<html><body><ul>" + "".join(map(row, range(4))) + "</ul></body></html>")
    cands = D.list_candidates(nodes).where("rank = 1")
    found = [f["selector"] for f in D.infer_fields(cands, nodes).collect() if f["selector"].endswith("b.x")]
    assert len(found) == 2 and [s.startswith("div.q") for s in found] == [False, True]


def test_discovery_broadcasts_no_elements(page):
    """Tables of elements compress so well that Spark broadcast them by the size of their files."""
    item = "<li class='{0}'><a href='/x'>Title of item</a></li>"
    nodes = nodes_of(page, "<html><body><nav><ul>" + "".join(item.format(c) for c in "aaabbb") + "</ul></nav></body></html>")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(D.list_candidates(nodes, merge=True))
    assert "Broadcast" not in plan(D.list_candidates(nodes, scope="nav"))
    assert "Broadcast" not in plan(D.unique_selector(nodes, nodes.where("tag = 'ul'")))


def test_groups_are_counted_once_and_only_depths_of_rows_are_looked_at(page, monkeypatch):
    plans, cut = [], D.cut
    monkeypatch.setattr(D, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    html = "<div class='g'>" + "".join(f"<div class='r'><p><b class='k'>key {i}</b></p><{t} class='v x'>value {i}</{t}></div>" for i, t in enumerate(["a", "div", "a", "div"])) + "</div>"
    nodes = nodes_of(page, html)
    cands = D.list_candidates(nodes).where("rank = 1")
    fields = D.infer_fields(cands, nodes)
    before = len(plans)
    got = {(f["name"], f["selector"]) for f in D.fix_field_coverage(fields, cands, nodes).collect()}
    assert ("v", ":scope > :is(a,div).v.x") in got or ("x", ":scope > :is(a,div).v.x") in got, got
    assert max(p.count("array_sort(") for p in plans[:before]) == 1
    assert not any("explode(anc_ids" in p for p in plans[before:])


def test_names_of_a_path_are_those_of_its_segments(spark):
    paths = ["html:1!/body:1!/div#a.b.c%2Ed:2", "html:1!", "html:1!/a:b.x:1!/p#i:1!", "html:1!/a.b#c.d:1!/x#y#z.w:3/td#q:1", "html:1!/b.#k:1!"]
    d = spark.createDataFrame([(p,) for p in paths], "path string")
    old = F.transform(D._segments(F.col("path")), lambda s: F.concat(F.array(s["tag"]), s["cls"]))
    rows = d.select(old.alias("old"), D._names(F.col("path")).alias("names"), D._path_tokens(F.col("path")).alias("toks")).collect()
    for r in rows:
        assert r["names"] == r["old"]
        assert [[s[0], *("." + c for c in s[1:])] for s in r["old"]] == r["toks"]
