"""The HTML reader on pages that are broken or deep, and selectors by place."""

import sys
import time

import pyarrow as pa
import pytest

from webframe.operators import structure as D
from webframe.operators.selectors import SelectorError, match, select_nodes
from webframe.schemas import NODE_FIELDS
from webframe.sources import nodes as N

BROKEN = {
    "open tags": lambda k: "<a " * k,
    "open quotes": lambda k: '<a "' * k + ">",
    "mixed quotes": lambda k: "<a ' \" x" * k + ">",
    "unclosed inline": lambda k: "<font>x<div>y</div>" * k,
    "unclosed below a list": lambda k: "<ul><li>" + "<font>x" * k + "<div></div>" * k,
    "end tags without start": lambda k: "<div>" * k + "</b>" * k,
}


@pytest.mark.parametrize("kind", sorted(BROKEN))
def test_time_grows_with_the_page_only(kind):
    def seconds(k):
        best = 9.0
        for _ in range(3):
            start = time.process_time()
            N.build_tree(BROKEN[kind](k))
            best = min(best, time.process_time() - start)
        return best

    small, large = seconds(4_000), seconds(32_000)
    assert large < 30 * max(small, 0.002)  # eight times the input; a square law gives 64


def test_batches_are_bounded_inside_a_page(monkeypatch):
    monkeypatch.setattr(N, "BATCH_BYTES", 100_000)
    columns = ("node_id", "text", "path")
    schema = pa.schema([pa.field("page_id", pa.int64())] + [pa.field(c, N._ARROW[NODE_FIELDS[c]]) for c in columns])
    batch = N._Batch(columns, None, (), schema)
    tree = N.build_tree("<div>text " * 500)
    parts = [*batch.add(1, (), "", tree), batch.emit()]
    assert len(parts) > 3 and max(p.nbytes for p in parts) < 200_000
    assert sum(p.num_rows for p in parts) == len(tree.tag) == 502


def test_unique_selectors_of_deep_pages(spark, page):
    html = "<body>" + "<div>" * 60 + "<b>x</b>" + "</div>" * 60 + "<div>" * 60 + "<b>y</b>" + "</div>" * 60 + "</body>"
    nodes = N.html_nodes(page(html), list(NODE_FIELDS)).cache()
    targets = nodes.where("tag = 'b' or depth % 9 = 5").select("page_id", "node_id")
    found = D.unique_selector(nodes, targets).collect()
    assert len(found) == targets.count()
    for r in found:
        assert [x.node_id for x in select_nodes(nodes, r.selector).select("node_id").collect()] == [r.node_id], r.selector


HTML = (
    "<table><tr><td>a1</td><td class=k>a2</td><td>a3</td></tr><tr><td>b1</td><td>b2</td></tr><tr><td>c1</td></tr></table>"
    "<div><h2>one</h2><p>p1</p><p>p2</p><span>s</span><p class=k>p3</p></div>"
)


@pytest.mark.parametrize("css,want", [
    ("td:nth-child(2)", "a2 b2"), ("tr:nth-child(2) td", "b1 b2"), ("td:first-child", "a1 b1 c1"), ("td:last-child", "a3 b2 c1"),
    ("td:only-child", "c1"), ("td:nth-child(odd)", "a1 a3 b1 c1"), ("td:nth-child(-n+2)", "a1 a2 b1 b2 c1"), ("td:nth-last-child(2)", "a2 b1"),
    ("td:not(.k)", "a1 a3 b1 b2 c1"), ("td:not(:first-child):not(.k)", "a3 b2"), ("h2 + p", "p1"), ("h2 ~ p", "p1 p2 p3"), ("p + span + p", "p3"),
    ("tr:first-child ~ tr > td:first-child", "b1 c1"), ("tr + tr td", "b1 b2 c1"), ("p:first-of-type", "p1"), ("span ~ p.k, td.k", "a2 p3"),
])
def test_selectors_by_place(page, css, want):
    nodes = N.html_nodes(page(HTML), list(NODE_FIELDS))
    got = [r.text for r in select_nodes(nodes, css).orderBy("node_id").collect()]
    assert got == want.split()


def test_siblings_need_rows():
    with pytest.raises(SelectorError):
        match("h2 + p")


def _read(html, columns, tags=None):
    schema = pa.schema([pa.field("page_id", pa.int64())] + [pa.field(c, N._ARROW[NODE_FIELDS[c]]) for c in columns])
    batch = N._Batch(columns, tags, (), schema)
    parts = [*batch.add(1, (), html, N.build_tree(html)), batch.emit()]
    return pa.Table.from_batches(parts), len(parts)


CARD = "<div class='card x'><a class='s' href='/p/1'>Part <b>1</b></a><i hidden>old</i><em id=e>$ 2.50</em></div>"


def test_calls_per_element_are_few():
    columns = ("node_id", "depth", "tag", "path", "anc_ids", "attrs", "own_text", "text")
    calls, pages = 0, [f"<body>{CARD * 4}</body>"] * 50
    _read(CARD, columns)  # imports are not counted

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        elements = sum(_read(html, columns)[0].num_rows for html in pages)
    finally:
        sys.setprofile(None)
    assert calls < 75 * elements  # 87 when every value had a call of its own, 66 now


def test_rows_do_not_depend_on_the_size_of_batches(monkeypatch):
    html = f"<body id='a/b'>{CARD * 40}<ul><li>x<li>y &amp; z</ul><img src=i>" + "<p class=''>t<div>" * 60
    columns = [c for c in NODE_FIELDS]
    whole, one = _read(html, columns)
    monkeypatch.setattr(N, "BATCH_BYTES", 4_000)
    cut, many = _read(html, columns)
    assert whole.equals(cut) and one == 1 and many > 30
    rows = {r["node_id"]: r for r in whole.to_pylist()}
    for r in rows.values():
        up = rows.get(r["parent_id"])
        assert r["anc_ids"] == ([*up["anc_ids"], up["node_id"]] if up else [])
        assert not up or r["path"].startswith(up["path"] + "/" + r["tag"])
