import pytest
from pyspark.sql import functions as F

from webframe.operators import selectors as S
from webframe.operators.extract import apply_transforms, extract_dom, finish_rows, node_columns, node_tags, transform_type, validate_items
from webframe.operators.rules import Field, Rule, read_rules, rule_from_row, validate_rules
from webframe.operators.selectors import SelectorError, parse
from webframe.schemas import NODE_FIELDS
from webframe.sources.nodes import build_tree, html_nodes


def extract(page, html, rule, url="http://h.example.com/x/y"):
    nodes = html_nodes(page(html, url), list(NODE_FIELDS), carry=("url",))
    return finish_rows(extract_dom(nodes, rule, ("url",)), rule).orderBy("item_id").collect()


def test_hidden_text_is_left_out(page):
    html = (
        '<ul><li class="it"><a class="txt" href="https://m.example.com/song?id=1">Title <span style="display:none">/song?id=1</span></a></li>'
        '<li class="it"><a class="txt" href="/a/1">Name<span hidden>rest</span></a></li>'
        '<li class="it"><a class="txt" href="/a/2">Main<span>sub</span></a></li><li class="it"><span class="txt">only text</span></li></ul>'
    )
    rows = extract(page, html, Rule("li.it", (Field("t", ".txt"), Field("both", ".txt", "text_with_href"))))
    assert [r["t"] for r in rows] == ["Title", "Name", "Mainsub", "only text"]
    assert [r["both"] for r in rows] == ["Title\nhttps://m.example.com/song?id=1", "Name\n/a/1", "Mainsub\n/a/2", "only text"]


def test_two_markups_of_one_column(page):
    li = '<li class="r"><a class="s-fc3" href="/a"><span class="s-fc7">In {0}</span></a></li>', '<li class="r"><a class="s-fc3" href="/a">Out {0}</a></li>'
    html = "<ul>" + "".join(li[0 if i < 11 else 1].format(i) for i in range(30)) + "</ul>"
    exact = extract(page, html, Rule("li.r", (Field("al", "span.s-fc7"),)))
    assert sum(r["al"] is not None for r in exact) == 11
    fallback = extract(page, html, Rule("li.r", (Field("al", "a.s-fc3 span.s-fc7"),)))
    assert sum(r["al"] is not None for r in fallback) == 30


def test_book_cards_with_required_fields(page):
    card = '<article class="product_pod"><h3><a href="c/{0}.html">Book {0}</a></h3><p class="price_color">£{0}.50</p><p class="instock availability"> In stock </p></article>'
    html = "<section>" + "".join(card.format(i) for i in (45, 52)) + '<article class="product_pod"><h3><a href="c/z.html">No price</a></h3></article></section>'
    rule = Rule(
        "article.product_pod",
        (Field("title", "h3 a", None, ("strip",), True), Field("price", "p.price_color", None, ("price",), True), Field("link", "h3 a", "href", ("url",), True), Field("stock", ".instock.availability", None, ("strip",))),
    )
    nodes = html_nodes(page(html, "http://books.example.com/cat/p1.html"), node_columns(rule), node_tags(rule), carry=("url",))
    rows = finish_rows(extract_dom(nodes, rule, ("url",)), rule).orderBy("item_id").collect()
    assert [(r["title"], r["price"], r["link"], r["stock"]) for r in rows] == [
        ("Book 45", 45.5, "http://books.example.com/cat/c/45.html", "In stock"), ("Book 52", 52.5, "http://books.example.com/cat/c/52.html", "In stock"),
    ]


def test_items_without_hits_and_nested_items(page):
    html = '<div class="i"><b>1</b><div class="i"><b>2</b></div></div><div class="i"></div>'
    rows = extract(page, html, Rule("div.i", (Field("b", "b"), Field("own", ":scope > b"), Field("re", "re:(\\d)"))))
    assert [(r["b"], r["own"], r["re"]) for r in rows] == [("1", "1", "1"), ("2", "2", "2"), (None, None, None)]


def test_ancestor_attributes(page):
    html = '<ul data-k="z"><li><a href="/1">a</a></li></ul><ul><li><a href="/2">b</a></li></ul>'
    rows = extract(page, html, Rule("ul[data-k] > li", (Field("t", "a"),)))
    assert [r["t"] for r in rows] == ["a"]
    rows = extract(page, html, Rule("li", (Field("t", "ul[data-k='z'] a"),)))
    assert [r["t"] for r in rows] == ["a", None]


def test_unsupported_selectors_say_so():
    for bad in ("a +", "+ a", "a + > b", "a:nth-child(x)", "a:hover", "> a", "//a/..", "", "a >"):
        with pytest.raises(SelectorError):
            parse(bad)


def test_tree_repairs():
    t = build_tree("<p>one<p>two<ul><li>a<li>b</ul><table><tr><td>x<td>y</table><img src=a><br>tail &amp; more<script>if(a<b){'</p>'}</script>")
    assert t.tag == ["html", "body", "p", "p", "ul", "li", "li", "table", "tbody", "tr", "td", "td", "img", "br", "script"]
    assert [t.parent[i] for i, x in enumerate(t.tag) if x == "li"] == [4, 4]
    assert "".join(t.pieces).strip().endswith("tail & more")
    assert build_tree('<a title="no end><b>x</b>').tag[:1] == ["html"]
    deep = build_tree("<div>" * 3000)
    assert len(deep.tag) == 3002 and deep.end[0] == 3001


def test_bad_page_is_a_row(page, spark):
    df = page({1: "<p>x</p>", 2: "", 3: None})
    assert {r["page_id"] for r in html_nodes(df, ["tag"]).collect()} == {1}


def test_transform_types(spark):
    assert [transform_type(t) for t in (("strip",), ("strip", "price"), ("int",), ("json",), ("price", "date"))] == ["string", "double", "bigint", "variant", "string"]
    d = spark.createDataFrame([("  A1,5 ",)], "t string")
    with pytest.warns(UserWarning):
        assert d.select(apply_transforms("t", ["strip", "nope", "lower"])).first()[0] == "a1,5"
    assert d.select(apply_transforms("t", ["regex:([A-Z])\\d", "lower"])).first()[0] == "a"


def test_rules_are_read_and_cleaned(spark, tmp_path):
    lines = [
        '{"mode":"odd","list_rule":{"item_selector":" li ","fields":[{"name":"t","selector":"a","attribute":"null","transform":"strip, lower"},{"name":"","selector":"b"}]},"pagination":{"next_selector":"a.n"}}',
        '{"mode":"json","list_rule":{"item_selector":"$.x[*]","fields":[{"name":"p","selector":"$.p","transform":["price"],"required":true}]}}',
        "{broken", "[1]", '{"list_rule":{"item_selector":"","fields":[]}}', "   ",
    ]
    path = tmp_path / "rules.txt"
    path.write_text("\n".join(lines))
    rows = {r["rule_json"]: r for r in read_rules(spark, str(path)).collect()}
    assert [rows[line]["status"] for line in lines] == ["ok", "ok", "parse_error", "schema_error", "incomplete", "empty"]
    rule = rule_from_row(rows[lines[0]])
    assert rule.mode == "dom" and rule.item_selector == "li" and rule.fields == (Field("t", "a", None, ("strip", "lower"), False),) and rule.next_selector == "a.n"
    back = validate_rules(spark.createDataFrame([(rule.to_json(),)], "rule_json string")).first()
    assert rule_from_row(back) == rule


def test_validate_items_keeps_two_messages(spark):
    d = spark.createDataFrame([(1, "5", "x", "y"), (2, "6", "7", "8")], "seq int, a string, b string, c string")
    valid, errors = validate_items(d, {"a": "int", "b": "int", "c": "int"})
    assert [r["seq"] for r in valid.collect()] == [2]
    assert [len(r["messages"]) for r in errors.collect()] == [2]


def test_validate_items_compares_integers_without_casting(spark):
    d = spark.sql("SELECT * FROM VALUES (1L, 127L), (2L, 128L), (3L, -128L), (4L, -129L), (5L, NULL), (6L, 9223372036854775807L) AS t(seq, a)")
    valid, errors = validate_items(d, {"a": "tinyint"})
    assert sorted(r["seq"] for r in valid.collect()) == [1, 3, 5]
    assert sorted(r["seq"] for r in errors.collect()) == [2, 4, 6]
    # a try_cast that fails costs an exception a row
    assert "try_cast" not in errors._jdf.queryExecution().optimizedPlan().toString().lower()


def test_items_above_an_element_are_worked_out_once_and_by_segments(spark, page):
    html = "<div class='card'><a:b class='t'>n</a:b><div class='card x'><a class='t' href='/1'>one</a><a.b class='t'>m</a.b></div></div>"
    nodes = html_nodes(page(html), ["node_id", "depth", "tag", "path", "anc_ids", "attrs", "own_text", "text"]).cache()
    for sel in ("div.card", "a.t", ".t", "div > a", "div.x .t", "a, .card", ":is(a, div)", "//div[@class='card']/a", "div:nth-of-type(1)"):
        for parsed in S.parse(sel):
            both = nodes.select("path", S.path_hit(parsed, F.col("path")).alias("new"), F.col("path").rlike(S.path_regex(parsed)).alias("old")).collect()
            assert all(r["new"] == r["old"] for r in both), (sel, both)
    rule = Rule("div.card", (Field("t", "a.t"), Field("first", ".t")))
    out = extract_dom(nodes, rule)
    assert sorted((r["t"], r["first"]) for r in out.collect()) == [("n", "n"), ("one", "one")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(path") == 1, plan
