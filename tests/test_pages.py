from webframe.operators import paging as G
from webframe.operators import report as R
from webframe.operators import repair as P
from webframe.operators.rules import Rule
from webframe.schemas import NODE_FIELDS
from webframe.sources.nodes import html_nodes
from webframe.sources.pages import read_pages


def test_four_paging_strategies(page):
    html = {
        1: '<nav><a href="/l?page=1">1</a><span>2</span><a href="/l?page=3">3</a><a href="/l?page=4">4</a><a href="/l?page=5">5</a></nav>',
        2: '<div><a href="/prev">‹ prev</a><a href="/n2">下一页</a></div>', 3: '<head><link rel="next" href="/n3"></head><body>x</body>',
        4: '<a href="/l?p=7">z</a><a href="/l?page=3"></a>', 5: "<p>nothing</p>", 6: '<a style="display:none" href="/h">next</a>',
    }
    pages = page(html)
    nodes = html_nodes(pages, G.NODE_COLUMNS, carry=("url",)).cache()
    got = {r["page_id"]: r for r in G.pagination(nodes).collect()}
    assert {i: r["strategy"] for i, r in got.items()} == {1: "numeric", 2: "text", 3: "rel-next", 4: "page-param"}
    assert got[1]["current_page"] == 2 and got[1]["next_text"] == "3" and got[4]["next_href"] == "/l?page=3"
    fixed = {r["page_id"]: (r["next_selector"], r["hits"]) for r in P.validate_pagination(pages, nodes, Rule("x", (), next_selector="nav > a"), G.pagination(nodes)).collect()}
    assert fixed[1] == ("nav > a", 4) and fixed[2] == (got[2]["next_selector"], 0) and fixed[5] == (None, 0)


def test_chains_stop(spark):
    pages = spark.createDataFrame([(i, f"http://h/p{i}") for i in range(1, 7)], "page_id bigint, url string")
    edges = spark.createDataFrame([(1, "http://h/p2"), (2, "http://h/p3"), (3, "http://h/p1"), (4, "http://h/p5"), (5, "http://h/p6"), (6, "http://h/gone")], "page_id bigint, next_url string")
    items = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 3, "c"), (4, 4, "x"), (5, 5, "x"), (6, 6, "y")], "page_id bigint, item_id int, content_hash string")
    starts = spark.createDataFrame([(1,), (4,)], "page_id bigint")
    chain = G.follow_pages(pages, edges, items, 5, starts)
    got = sorted((r["start_id"], r["step"], r["page_id"], r["no_new_rows"]) for r in chain.collect())
    assert got == [(1, 1, 1, False), (1, 2, 2, False), (1, 3, 3, False), (4, 1, 4, False), (4, 2, 5, True)]
    assert sorted(r["content_hash"] for r in G.chain_items(chain, items).collect()) == ["a", "b", "c", "x"]


def test_metadata_and_outline(page):
    html = (
        "<head><title>T</title><script type='application/ld+json'>{\"a\":1}</script><script type='application/ld+json'>{bad</script>"
        "<meta property='og:title' content='A'><meta property='og:title' content='B'><meta name='twitter:card' content='c'></head>"
        "<body><nav><a href='/x'>x</a></nav><main><span itemprop='p' content='1'></span><b itemprop='q'>txt</b>" + "<img src='/i.jpg'>" * 3 + "</main></body>"
    )
    nodes = html_nodes(page(html), list(NODE_FIELDS)).cache()
    m = R.structured_metadata(nodes).first()
    assert m["json_ld"] == ['{"a":1}'] and m["open_graph"] == {"og:title": "B", "twitter:card": "c"}
    assert [(x["itemprop"], x["content"], x["text"]) for x in m["microdata"]] == [("p", "1", None), ("q", None, "txt")]
    t = R.simplified_tree(nodes).first()
    assert t["tree"].splitlines()[:2] == ["body", "  main"] and t["image_coverage"] == 1.0 and not t["truncated_nodes"]
    small = R.simplified_tree(nodes, max_nodes=4, child_cap=2).first()
    assert small["nodes"] == 4 and small["truncated_nodes"] and small["image_coverage"] < 1
    shallow = R.simplified_tree(nodes, max_depth=1).first()
    assert shallow["truncated_depth"] and shallow["nodes"] == 3
    docs = page({1: "x"}).sparkSession.createDataFrame([(1, 0, False, 0, 100, 0), (1, 1, False, 3, 110, 2)], "page_id bigint, doc_no int, scope_matched boolean, candidates int, elements int, images int")
    best = R.richest_document(docs).first()
    assert best["doc_no"] == 1 and best["incomplete"]


def test_scan_prunes_and_filters(spark, sf):
    df = read_pages(spark, f"{sf}/pages.parquet", max_chars=100_000).select("page_id").where("page_id > 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan and "GreaterThan(page_id,3)]" in plan.split("PushedFilters:")[1]


def test_long_chains_rings_and_branches(spark):
    url = lambda i: f"http://h/{i}"
    links = [(i, i + 1) for i in range(1000)] + [(2000, 2001), (2001, 2002), (2002, 2000)] + [(3000, 3001), (3001, 3002), (3002, 3001)] + [(4000, 500), (5000, 5000)]
    ids = sorted({x for e in links for x in e} | {6000})
    pages = spark.createDataFrame([(i, url(i)) for i in ids], "page_id bigint, url string")
    edges = spark.createDataFrame([(a, url(b)) for a, b in links] + [(6000, "http://elsewhere/")], "page_id bigint, next_url string")
    chains = {}
    for r in G.page_chains(pages, edges).collect():
        chains.setdefault(r.start_id, {})[r.step] = r.page_id
    got = {s: [c[k] for k in sorted(c)] for s, c in chains.items()}
    assert got == {0: list(range(1001)), 2000: [2000, 2001, 2002], 3000: [3000, 3001, 3002], 4000: [4000, *range(500, 1001)], 5000: [5000], 6000: [6000]}
    short = G.page_chains(pages, edges, 3, starts=pages.where("page_id in (10, 2001, 999)")).collect()
    assert sorted((r.start_id, r.step, r.page_id) for r in short) == [(10, 1, 10), (10, 2, 11), (10, 3, 12), (999, 1, 999), (999, 2, 1000), (2001, 1, 2001), (2001, 2, 2002), (2001, 3, 2000)]
    assert sorted({r.start_id for r in G.page_chains(pages, edges, 2).collect()}) == [0, 2000, 3000, 4000, 5000, 6000]
    assert G.page_chains(pages.limit(0), edges).count() == 0
