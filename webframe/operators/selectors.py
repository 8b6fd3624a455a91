"""CSS and XPath selectors as Columns over element rows.

A node row carries ``path``, its own and all ancestor segments as
``tag#id.class:nth`` joined by '/' (with '!' where it is the only one of its type). A selector therefore is one regular
expression on one string column plus attribute tests on the row itself; no
join and no UDF is needed. Only selectors that test an attribute of an
*ancestor* need a join, see ``select_nodes``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.sources.nodes import escape_token

_ANY_SEG = r"[^/]+"
_SIMPLE = re.compile(
    r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>(?:\\[0-9a-fA-F]{6}|\\.|[\w\u0080-\uffff-])+)|\.(?P<cls>(?:\\[0-9a-fA-F]{6}|\\.|[\w\u0080-\uffff-])+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[\^$*~]?=)\s*(?P<val>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^\s\]]+)\s*(?P<ci>[iI])?\s*)?\]
    |:nth-of-type\(\s*(?P<nth>\d+)\s*\)|:is\((?P<alts>[^()]*)\)|:not\((?P<nots>[^()]*)\)
    |:nth-(?P<from_end>last-)?child\(\s*(?P<step>odd|even|[+-]?\d*n(?:\s*[+-]\s*\d+)?|\d+)\s*\)
    |:(?P<place>first-child|last-child|only-child|first-of-type)""",
    re.X,
)


COMBINATORS = (">", "+", "~")
SIBLINGS = ("+", "~")


class SelectorError(ValueError):
    """The selector is outside the supported grammar."""


@dataclass
class Compound:
    tag: str | None = None
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    attrs: list[tuple] = field(default_factory=list)
    nth: int | None = None
    alts: list["Compound"] = field(default_factory=list)
    nots: list["Compound"] = field(default_factory=list)
    places: list[tuple[bool, int, int]] = field(default_factory=list)
    text_has: str | None = None

    def needs_row(self) -> bool:
        return bool(self.attrs or self.text_has or self.nots or self.places or any(a.needs_row() for a in self.alts))


@dataclass
class Selector:
    """Steps from left to right; each has the combinator that leads to it."""

    steps: list[tuple[str, Compound]]
    scoped: bool = False


def is_xpath(selector: str) -> bool:
    return selector.strip().startswith(("xpath=", "//", "(//", "./", ".."))


def _unescape(name: str) -> str:
    name = re.sub(r"\\([0-9a-fA-F]{6})", lambda m: chr(int(m[1], 16)), name)
    return re.sub(r"\\(.)", r"\1", name)


def _every(step: str) -> tuple[int, int]:
    """``an+b`` as (a, b)."""
    step = {"odd": "2n+1", "even": "2n"}.get(step, step.replace(" ", ""))
    if "n" not in step:
        return 0, int(step)
    a, b = step.split("n")
    return {"": 1, "+": 1, "-": -1}.get(a) or int(a or 0), int(b or 0)


def _compound(text: str) -> Compound:
    out, pos = Compound(), 0
    while pos < len(text):
        m = _SIMPLE.match(text, pos)
        if not m or m.end() == pos:
            raise SelectorError(f"unsupported selector part {text[pos:]!r}")
        pos = m.end()
        if m["tag"]:
            out.tag = None if m["tag"] == "*" else m["tag"].lower()
        elif m["id"]:
            out.ids.append(_unescape(m["id"]))
        elif m["cls"]:
            out.classes.append(_unescape(m["cls"]))
        elif m["attr"]:
            val = m["val"]
            if val is not None:
                val = _unescape(val[1:-1]) if val[0] in "\"'" else val
            out.attrs.append((m["attr"].lower(), m["op"], val, bool(m["ci"])))
        elif m["nth"]:
            out.nth = int(m["nth"])
        elif m["nots"] is not None:
            out.nots += [_compound(a.strip()) for a in m["nots"].split(",")]
        elif m["step"]:
            out.places.append((bool(m["from_end"]), *_every(m["step"])))
        elif m["place"] == "first-of-type":
            out.nth = 1
        elif m["place"]:
            ends = {"first-child": [False], "last-child": [True], "only-child": [False, True]}[m["place"]]
            out.places += [(from_end, 0, 1) for from_end in ends]
        else:
            out.alts = [_compound(a.strip()) for a in m["alts"].split(",")]
    return out


def _split(text: str, on_comma: bool) -> list[str]:
    """Split at top-level commas, or at top-level combinators (kept as items)."""
    parts, depth, quote, cur = [], 0, "", ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif depth == 0 and on_comma and ch == ",":
            parts.append(cur)
            cur = ""
            continue
        elif depth == 0 and not on_comma and ch in " >+~\t\n":
            if cur:
                parts.append(cur)
                cur = ""
            if ch in ">+~":
                parts.append(ch)
            continue
        cur += ch
    return parts + ([cur] if cur.strip() or on_comma else [])


def parse_css(selector: str) -> list[Selector]:
    out = []
    for part in _split(selector, on_comma=True):
        tokens, steps, comb, scoped = _split(part.strip(), on_comma=False), [], " ", False
        for i, tok in enumerate(tokens):
            if tok == ":scope" and i == 0:
                scoped = True
            elif tok in COMBINATORS:
                comb = tok
            else:
                steps.append((comb, _compound(tok)))
                comb = " "
        doubled = any(a in COMBINATORS and b in COMBINATORS for a, b in zip(tokens, tokens[1:]))
        first = steps[0][0] if steps else ""
        if not steps or doubled or tokens[-1] in COMBINATORS or first in SIBLINGS or (first == ">" and not scoped):
            raise SelectorError(f"empty or dangling selector {selector!r}")
        out.append(Selector(steps, scoped))
    return out


_STEP = re.compile(r"(//|/)((?:[\w-]+|\*))((?:\[[^\]]*\])*)")
_PRED = re.compile(
    r"\[\s*(?:(?P<n>\d+)|@(?P<a>[\w:-]+)\s*(?:=\s*(?P<v>'[^']*'|\"[^\"]*\"))?"
    r"|contains\(\s*(?P<what>text\(\)|\.|@[\w:-]+)\s*,\s*(?P<s>'[^']*'|\"[^\"]*\")\s*\))\s*\]"
)


def parse_xpath(expr: str) -> list[Selector]:
    """``//a/b[2][@x='v'][contains(text(),'t')]``; steps on the child and descendant axes."""
    expr = re.sub(r"^xpath=", "", expr.strip())
    scoped = expr.startswith(".")
    body = expr[1:] if scoped else expr
    steps, pos = [], 0
    while pos < len(body):
        m = _STEP.match(body, pos)
        if not m:
            raise SelectorError(f"unsupported XPath {expr!r}")
        pos = m.end()
        c = Compound(tag=None if m[2] == "*" else m[2].lower())
        at = 0
        while at < len(m[3]):
            p = _PRED.match(m[3], at)
            if not p:
                raise SelectorError(f"unsupported XPath predicate {m[3]!r}")
            at = p.end()
            if p["n"]:
                if c.tag is None:
                    raise SelectorError("position on '*' is not supported")
                c.nth = int(p["n"])
            elif p["a"]:
                c.attrs.append((p["a"], "=" if p["v"] else None, p["v"][1:-1] if p["v"] else None, False))
            elif p["what"].startswith("@"):
                c.attrs.append((p["what"][1:], "*=", p["s"][1:-1], False))
            else:
                c.text_has = p["s"][1:-1]
        steps.append((" " if m[1] == "//" else ">", c))
    if not steps:
        raise SelectorError(f"empty XPath {expr!r}")
    if not scoped and steps[0][0] == ">":
        return [Selector(steps, True)] if steps[0][1].tag == "html" else [Selector([(" ", Compound("html"))] + steps)]
    return [Selector(steps, scoped)]


def parse(selector: str) -> list[Selector]:
    return parse_xpath(selector) if is_xpath(selector) else parse_css(selector)


def _seg(c: Compound) -> str:
    look = "".join(rf"(?=[^/]*#{re.escape(escape_token(i))}[.:])" for i in c.ids)
    look += "".join(rf"(?=[^/]*\.{re.escape(escape_token(k))}[.:])" for k in c.classes)
    if c.nth is not None:
        look += rf"(?=[^/]*:{c.nth}!?(?:/|$))"
    if c.alts:
        look += "(?=" + "|".join(_seg(a) for a in c.alts) + ")"
    head = re.escape(c.tag) + r"(?=[#.:])" if c.tag else ""
    return f"{look}{head}[^/]*"


def path_regex(sel: Selector) -> str:
    out = "^"
    for comb, c in sel.steps:
        if out != "^":
            out += "/"
        out += (r"(?:[^/]+/)*" if comb == " " else "") + _seg(c)
    return out + "$"


def path_hit(sel: Selector, path: Column, last: Column | None = None) -> Column:
    """Does a path meet a selector? ``last`` is its last segment, which is looked at first: patterns on whole paths cost most."""
    last = F.substring_index(path, "/", -1) if last is None else last
    comb, leaf = sel.steps[-1]
    tests = [last.startswith(leaf.tag)] if leaf.tag else []
    if sel.scoped or len(sel.steps) > 1 or comb != " ":
        tests.append(path.rlike(path_regex(sel)))
    else:
        tests.append(last.rlike(f"^{_seg(leaf)}$"))
    return reduce(Column.__and__, tests)


def _attr_test(attrs: Column, test: tuple) -> Column:
    name, op, value, ci = test
    v = F.try_element_at(attrs, F.lit(name))
    if op is None:
        return v.isNotNull()
    if ci:
        v, value = F.lower(v), value.lower()
    hit = {
        "=": lambda: v == value,
        "^=": lambda: v.startswith(value),
        "$=": lambda: v.endswith(value),
        "*=": lambda: v.contains(value),
        "~=": lambda: F.array_contains(F.split(v, r"\s+"), value),
    }[op]()
    return F.coalesce(hit, F.lit(False))


def _row_test(c: Compound) -> Column:
    tests = [_attr_test(F.col("attrs"), t) for t in c.attrs]
    for from_end, a, b in c.places:
        here = F.greatest("sib_pos", F.lit(1))
        ahead = (F.col("sib_count") - here + 1 if from_end else here) - b
        tests.append(ahead == 0 if a == 0 else (ahead % abs(a) == 0) & (ahead >= 0 if a > 0 else ahead <= 0))
    for other in c.nots:
        tests.append(~(F.col("path").rlike(f"(^|/){_seg(other)}$") & _row_test(other)))
    if c.text_has:
        tests.append(F.col("own_text").contains(c.text_has))
    if any(a.needs_row() for a in c.alts):
        tests.append(reduce(Column.__or__, [F.lit(True) & _row_test(a) & F.col("path").rlike(f"(^|/){_seg(a)}$") for a in c.alts]))
    return reduce(Column.__and__, tests, F.lit(True))


def ancestor_tests(selector: str) -> bool:
    """Does the selector test siblings, or an ancestor's attributes, text or place? (then it needs ``select_nodes``)"""
    return any(
        c.needs_row() for s in parse(selector) for _, c in s.steps[:-1]
    ) or any(comb in SIBLINGS for s in parse(selector) for comb, _ in s.steps)


def row_columns(selector: str) -> set[str]:
    """Columns beyond path, tag and attributes that the selector's tests read."""
    steps = [step for s in parse(selector) for step in s.steps]
    out = {"sib_pos", "sib_count"} if any(c.places or any(n.places for n in (*c.nots, *c.alts)) for _, c in steps) else set()
    return out | ({"sib_pos", "parent_id"} if any(comb in SIBLINGS for comb, _ in steps) else set())


def match(selector: str, path: Column | None = None) -> Column:
    """Boolean Column: does this node match? (selectors without ancestor attribute tests)"""
    path = F.col("path") if path is None else path
    tests = []
    for sel in parse(selector):
        if any(c.needs_row() for _, c in sel.steps[:-1]) or any(comb in SIBLINGS for comb, _ in sel.steps):
            raise SelectorError(f"{selector!r} tests siblings or an ancestor's attributes; use select_nodes")
        leaf = sel.steps[-1][1]
        if not sel.scoped and len(sel.steps) == 1 and leaf.tag and not (leaf.ids or leaf.classes or leaf.alts or leaf.nth):
            hit = F.col("tag") == leaf.tag
        else:
            hit = path_hit(sel, path)
        tests.append(hit & _row_test(leaf) if leaf.needs_row() else hit)
    return reduce(Column.__or__, tests)


def leaf_tags(selector: str) -> set[str] | None:
    """Tags the matching node can have; None when any."""
    tags: set[str] = set()
    for sel in parse(selector):
        c = sel.steps[-1][1]
        if c.tag:
            tags.add(c.tag)
        elif c.alts and all(a.tag for a in c.alts):
            tags.update(a.tag for a in c.alts)
        else:
            return None
    return tags


def select_nodes(nodes: DataFrame, selector: str) -> DataFrame:
    """Rows of *nodes* that match a CSS or XPath selector.

    Selectors testing an ancestor's attributes are cut after that ancestor:
    its matches are found first, and the rows below are found by an equi-join
    on the exploded ancestor ids (hash-partitioned by page and node, so no
    page becomes a hot key and no range join is needed). Sibling combinators
    (``+``, ``~``) join on the parent, with ``+`` on the place as well.
    """
    parts = [_select_one(nodes, sel) for sel in parse(selector)]
    if len(parts) == 1:
        return parts[0]
    hits = reduce(DataFrame.unionByName, [p.select("page_id", "node_id") for p in parts]).distinct()
    return nodes.join(hits, ["page_id", "node_id"], "left_semi")


def _beside(nodes: DataFrame, sel: Selector) -> DataFrame:
    """The last step of *sel* as a sibling of what the steps before it match."""
    comb, leaf = sel.steps[-1]
    left = _select_one(nodes, Selector(sel.steps[:-1], sel.scoped))
    mine = nodes.where(F.col("path").rlike(f"(^|/){_seg(leaf)}$") & _row_test(leaf))
    if comb == "+":
        before = left.select("page_id", "parent_id", (F.col("sib_pos") + 1).alias("sib_pos"))
        return mine.join(before, ["page_id", "parent_id", "sib_pos"], "left_semi")
    before = left.groupBy("page_id", "parent_id").agg(F.min("sib_pos").alias("_from"))
    hits = mine.select("page_id", "node_id", "parent_id", "sib_pos").join(before, ["page_id", "parent_id"]).where("sib_pos > _from")
    return nodes.join(hits.select("page_id", "node_id"), ["page_id", "node_id"], "left_semi")


def _select_one(nodes: DataFrame, sel: Selector) -> DataFrame:
    leaf = sel.steps[-1][1]
    if sel.steps[-1][0] in SIBLINGS:
        return _beside(nodes, sel)
    cut = max((i for i, (comb, c) in enumerate(sel.steps[:-1]) if c.needs_row() or comb in SIBLINGS), default=None)
    if cut is None:
        hit = F.col("path").rlike(path_regex(sel))
        return nodes.where(hit & _row_test(leaf) if leaf.needs_row() else hit)
    head = Selector(sel.steps[: cut + 1], sel.scoped)
    ups = _select_one(nodes, head).select("page_id", F.col("node_id").alias("_up"), F.col("depth").alias("_ud"))
    tail = Selector(sel.steps[cut + 1:], True)
    below = nodes.where(F.col("path").rlike(f"(^|/){_seg(leaf)}$") & _row_test(leaf)).select(
        "page_id", "node_id", "path", "depth", F.explode("anc_ids").alias("_up")
    )
    rel = F.expr("substring_index(path, '/', _ud - depth)")
    hits = below.join(ups, ["page_id", "_up"]).where(rel.rlike(path_regex(tail))).select("page_id", "node_id").distinct()
    return nodes.join(hits, ["page_id", "node_id"], "left_semi")
