"""Extraction by a table of rules: any number of sites and rules in one plan.

The selectors of all rules become rows, one per step. A join by site and tag says
which elements satisfy which step; per element and selector these are the bits of a
number. A selector matches an element if its steps are met on the way from the root
down to it, which a fold over the ancestors' numbers decides: after every ancestor
it knows which first steps have been met anywhere above, and which exactly there
(for ``>``). Neither the number of joins nor the plan depends on the rules.

Hits and items are tables as large as the corpus in small files, so joins of them are merges:
a broadcast by the size of the files would not fit the driver.

``rules`` are rows as :func:`webframe.operators.rules.validate_rules` returns them,
with ``rule_id`` and ``site``; ``nodes`` are element rows with a column ``site``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webframe.functions import text as T
from webframe.functions.common import let
from webframe.functions.urls import absolutize, is_link_name_column
from webframe.operators import selectors as S
from webframe.operators.structure import PRIMARY_NAMES
from webframe.plans.lineage import cut
from webframe.plans.ordering import dealt

#: Columns of the element source that matching and values read (``inner_html`` only if some field asks for ``html``).
NODE_COLUMNS = (
    "node_id", "depth", "tag", "elem_id", "classes", "attrs", "nth_of_type", "sib_pos", "sib_count", "own_text", "anc_ids", "text",
)
#: Steps of a selector are bits of a long.
MAX_STEPS = 62
_ATTRS = "array<struct<name:string,op:string,value:string,ci:boolean>>"
_PLACES = "array<struct<from_end:boolean,a:int,b:int>>"
_PLAIN = f"tag:string,ids:array<string>,classes:array<string>,nth:int,attrs:{_ATTRS},places:{_PLACES},has:string"
_STEP = f"struct<i:int,child:boolean,{_PLAIN},nots:array<struct<{_PLAIN}>>>"
PARSED = f"struct<problem:string,variants:array<array<struct<scoped:boolean,n:int,steps:array<{_STEP}>>>>>"


def _plain(c: S.Compound) -> dict:
    attrs = [{"name": n, "op": op, "value": v.lower() if ci else v, "ci": ci} for n, op, v, ci in c.attrs]
    places = [{"from_end": e, "a": a, "b": b} for e, a, b in c.places]
    return {"tag": c.tag, "ids": c.ids, "classes": c.classes, "nth": c.nth, "attrs": attrs, "places": places, "has": c.text_has}


def _spelled_out(c: S.Compound) -> list[dict]:
    """A compound as alternatives without ``:is()``."""
    own = _plain(c) | {"nots": []}
    for other in c.nots:
        if other.alts or other.nots:
            raise S.SelectorError("alternatives inside :not() are not supported in rule tables")
        own["nots"].append(_plain(other))
    if not c.alts:
        return [own]
    out = []
    for alt in c.alts:
        for more in _spelled_out(alt):
            if (own["tag"] and more["tag"] and own["tag"] != more["tag"]) or (own["nth"] and more["nth"] and own["nth"] != more["nth"]):
                continue
            joined = {k: own[k] + more[k] for k in ("ids", "classes", "attrs", "places", "nots")}
            out.append(joined | {k: own[k] or more[k] for k in ("tag", "nth", "has")})
    return out


def _parsed(selector: str) -> list[dict]:
    out = []
    for sel in S.parse(selector):
        if any(comb in S.SIBLINGS for comb, _ in sel.steps):
            raise S.SelectorError("sibling combinators are not supported in rule tables")
        if len(sel.steps) > MAX_STEPS:
            raise S.SelectorError(f"more than {MAX_STEPS} steps")
        steps = [{"i": i, "child": comb == ">"} | one for i, (comb, c) in enumerate(sel.steps) for one in _spelled_out(c)]
        out.append({"scoped": sel.scoped, "n": len(sel.steps), "steps": steps})
    return out


def parse_text(selector: str | None) -> str:
    """A selector and its shortened variants as JSON (``PARSED``); what cannot be parsed says why."""
    selector = (selector or "").strip()
    try:
        variants = [_parsed(selector)]
    except S.SelectorError as e:
        return json.dumps({"problem": str(e), "variants": []})
    words = [] if S.is_xpath(selector) else selector.split()
    for n in range(len(words) - 1, 0, -1):
        try:
            variants.append(_parsed(" ".join(words[:n])))
        except S.SelectorError:
            continue
    return json.dumps({"problem": None, "variants": variants})


@F.pandas_udf(StringType())
def _parse(selectors: pd.Series) -> pd.Series:
    return selectors.map(parse_text)


def selector_uses(rules: DataFrame) -> DataFrame:
    """``site, rule_id, role, k, name, attribute, selector, problem, variants``: every selector of the rules, parsed.

    ``role`` is item, field or next; ``k`` the field's place. ``problem`` tells why a selector is not used.
    """
    role = lambda r, k, name, attribute, sel: F.struct(
        F.lit(r).alias("role"), k.alias("k"), name.alias("name"), attribute.alias("attribute"), sel.alias("selector"))
    none = F.lit(None).cast("string")
    fields = F.transform("list_rule.fields", lambda f, k: role("field", k, f["name"], f["attribute"], f["selector"]))
    ends = F.array(
        role("item", F.lit(0), none, none, F.col("list_rule.item_selector")),
        role("next", F.lit(0), none, none, F.col("pagination.next_selector")),
    )
    d = rules.select("site", "rule_id", F.explode(F.concat(ends, fields)).alias("u")).select("site", "rule_id", "u.*")
    d = d.where(F.col("selector").isNotNull() & ~F.col("selector").startswith("re:"))
    return d.withColumn("p", F.from_json(_parse("selector"), PARSED)).select("*", "p.problem", "p.variants").drop("p")


def _steps(uses: DataFrame) -> DataFrame:
    """One row per step of every alternative of every variant."""
    d = uses.select("site", "rule_id", "role", "k", "attribute", F.posexplode("variants").alias("variant", "alts"))
    d = d.where((F.col("role") == "field") | (F.col("variant") == 0))
    d = d.select("*", F.posexplode("alts").alias("alt", "a")).drop("alts")
    childs = F.aggregate("a.steps", F.lit(0).cast("long"), lambda m, s: m.bitwiseOR(F.when(s["child"], F.call_function("shiftleft", F.lit(1).cast("long"), s["i"])).otherwise(0)))
    return d.select(
        "site", "rule_id", "role", "k", "attribute", "variant", F.concat_ws(".", "role", "k", "variant", "alt").alias("sel"),
        F.col("a.scoped").alias("scoped"), F.col("a.n").alias("n"), childs.alias("childs"), F.explode("a.steps").alias("s"),
    )


def _attr_ok(t: Column) -> Column:
    v = F.try_element_at("attrs", t["name"])
    low = F.when(t["ci"], F.lower(v)).otherwise(v)
    op, want = t["op"], t["value"]
    hit = (
        F.when(op.isNull(), v.isNotNull()).when(op == "=", low == want).when(op == "^=", low.startswith(want))
        .when(op == "$=", low.endswith(want)).when(op == "*=", low.contains(want)).otherwise(F.array_contains(F.split(low, r"\s+"), want))
    )
    return F.coalesce(hit, F.lit(False))


def _place_ok(p: Column) -> Column:
    here = F.greatest("sib_pos", F.lit(1))
    ahead = F.when(p["from_end"], F.col("sib_count") - here + 1).otherwise(here) - p["b"]
    return F.when(p["a"] == 0, ahead == 0).otherwise((F.try_mod(ahead, F.abs(p["a"])) == 0) & F.when(p["a"] > 0, ahead >= 0).otherwise(ahead <= 0))


def _satisfies(s: Column) -> Column:
    """Does the element of this row satisfy a compound, its tag aside?"""
    return (
        F.forall(s["ids"], lambda x: F.coalesce(F.col("elem_id") == x, F.lit(False)))
        & (F.size(F.array_except(s["classes"], "classes")) == 0)
        & (s["nth"].isNull() | (F.col("nth_of_type") == s["nth"]))
        & F.forall(s["attrs"], _attr_ok)
        & F.forall(s["places"], _place_ok)
        & (s["has"].isNull() | F.col("own_text").contains(s["has"]))
    )


def _value(attribute: Column, has_html: bool) -> Column:
    text = F.col("text")
    href = F.trim(F.coalesce(F.try_element_at("attrs", F.lit("href")), F.lit("")))
    both = F.nullif(F.concat_ws("\n", T.null_if_empty("text"), F.nullif(href, F.lit(""))), F.lit(""))
    out = F.when(attribute.isNull() | attribute.isin("", "text"), text).when(attribute.isin("text_with_href", "text+href"), both)
    if has_html:
        out = out.when(attribute == "html", F.col("inner_html"))
    return out.otherwise(F.trim(F.try_element_at("attrs", attribute)))


def _hits(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Elements that satisfy some step: the steps as bits, the value where the last one is among them."""
    e = dealt(nodes, "page_id").withColumnRenamed("site", "_site")
    s = steps.select("*", F.col("s.tag").alias("_tag"))
    # elements meet steps by site and tag; steps for any tag by site alone
    by_tag = e.join(s.where(F.col("_tag").isNotNull()), (F.col("_site") == F.col("site")) & (F.col("tag") == F.col("_tag")))
    by_any = e.join(s.where(F.col("_tag").isNull()), F.col("_site") == F.col("site"))
    met = by_tag.unionByName(by_any)
    wrong = F.exists("s.nots", lambda x: (x["tag"].isNull() | (x["tag"] == F.col("tag"))) & _satisfies(x))
    met = met.where(_satisfies(F.col("s")) & ~wrong)
    last = F.col("s.i") == F.col("n") - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s.i"))
    return met.groupBy("page_id", "node_id", "rule_id", "sel").agg(
        F.bit_or(bit).alias("h"), F.max(F.when(last, _value(F.col("attribute"), "inner_html" in nodes.columns))).alias("value"),
        *[F.first(c).alias(c) for c in ("role", "k", "variant", "scoped", "n", "childs", "depth", "anc_ids")],
    )


def _reached(up: Column, start: Column, childs: Column, n: Column) -> Column:
    """Are all steps met along ``up`` (array of depth and bits, ending at the element), entered below depth ``start``?"""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    begin = F.struct(one.alias("any"), one.alias("at"), start.cast("int").alias("depth"))

    def descend(s: Column, x: Column) -> Column:
        here = F.when(x["depth"] == s["depth"] + 1, s["at"]).otherwise(none)
        ready = s["any"].bitwiseAND(F.bitwise_not(childs)).bitwiseOR(here.bitwiseAND(childs))
        met = F.shiftleft(ready.bitwiseAND(x["h"]), 1)
        return F.struct(s["any"].bitwiseOR(met).alias("any"), met.alias("at"), x["depth"].alias("depth"))

    done = F.aggregate(up, begin, descend)["at"]
    return F.coalesce(done.bitwiseAND(F.call_function("shiftleft", one, n)) != 0, F.lit(False))


def match_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Elements that the rules' selectors end at: ``page_id, node_id, rule_id, role, k, variant, value, scoped, up, ...``.

    Whole-page selectors are decided here; a scoped one (``:scope``, ``./``) still needs the item it starts from.
    """
    steps = cut(_steps(selector_uses(rules)))
    hits = cut(_hits(nodes, steps))
    ends = hits.where(F.col("h").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n") - 1)) != 0)
    above = ends.where(F.col("n") > 1).select("page_id", "node_id", "rule_id", "sel", F.explode("anc_ids").alias("up"))
    there = hits.select("page_id", F.col("node_id").alias("up"), "rule_id", "sel", F.struct("depth", "h").alias("x"))
    ups = above.join(there.hint("merge"), ["page_id", "up", "rule_id", "sel"]).groupBy("page_id", "node_id", "rule_id", "sel").agg(F.collect_list("x").alias("ups"))
    d = ends.join(ups.hint("merge"), ["page_id", "node_id", "rule_id", "sel"], "left")
    none = F.array().cast("array<struct<depth:int,h:bigint>>")
    d = d.withColumn("up", F.array_append(F.array_sort(F.coalesce("ups", none)), F.struct("depth", "h"))).drop("ups", "h")
    inner = F.col("scoped") & (F.col("role") == "field")
    return d.where(inner | _reached(F.col("up"), F.lit(-1), F.col("childs"), F.col("n")))


def extract_by_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """``rule_id, page_id, item_id, data`` per item: ``data`` maps every field of the rule to its raw value or null.

    As :func:`webframe.operators.extract.extract_dom`, for all rules at once: the first
    variant of a field's selector that an element inside the item matches decides, the
    first element in document order counts. Items without any hit are kept, rules whose
    item selector cannot be parsed give nothing (see :func:`selector_uses`). Of fields
    with one name the first is kept. ``re:`` selectors give null here.
    """
    found = cut(match_rules(nodes, rules))
    items = found.where("role = 'item'").select("rule_id", "page_id", F.col("node_id").alias("item_id"), F.col("depth").alias("item_depth")).distinct()
    items = cut(items)
    inside = found.where("role = 'field'").withColumn("item_id", F.explode("anc_ids")).join(items.hint("merge"), ["rule_id", "page_id", "item_id"])
    below = F.filter("up", lambda x: x["depth"] > F.col("item_depth"))
    inside = inside.where(~F.col("scoped") | _reached(below, F.col("item_depth"), F.col("childs"), F.col("n")))
    first = inside.groupBy("rule_id", "page_id", "item_id", "k").agg(F.min(F.struct("variant", "node_id", "value")).alias("v"))
    values = first.groupBy("rule_id", "page_id", "item_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v.value"))).alias("by_k"))
    # cut, so that its size is known: one rule can have all items, and a shuffle by rule would send them to one task
    names = cut(rules.select("rule_id", F.col("list_rule.fields").alias("fields")))
    d = items.join(values.hint("merge"), ["rule_id", "page_id", "item_id"], "left").join(names, "rule_id")
    taken = F.transform("fields", lambda f, k: F.struct(f["name"].alias("key"), F.try_element_at("by_k", k).alias("value")))
    once = F.filter(taken, lambda e, i: ~F.exists(F.slice(taken, F.lit(1), i), lambda x: x["key"] == e["key"]))
    return d.select("rule_id", "page_id", "item_id", F.map_from_entries(once).alias("data"))


def _step_done(step: Column, v: Column, base: Column) -> Column:
    as_text = lambda c: c.cast("string")
    return (
        F.when(step == "strip", T.strip(v)).when(step == "lower", F.lower(v)).when(step == "upper", F.upper(v))
        .when(step == "int", as_text(T.to_int(v))).when(step.isin("float", "number"), as_text(T.to_float(v)))
        .when(step == "price", as_text(T.to_price(v))).when(step == "date", T.to_date_text(v)).when(step == "url", T.to_url(v, base))
        .otherwise(v)
    )


def finish_by_rules(items: DataFrame, rules: DataFrame, base: str = "url") -> DataFrame:
    """Cleaning steps of every field, links made absolute by name, items without a required field dropped.

    Values stay texts. ``regex:`` and unknown steps leave a value as it is here:
    patterns cannot be checked before they meet the data.
    """
    specs = rules.select("rule_id", F.col("list_rule.fields").alias("_fields"))
    d = items.join(specs, "rule_id")
    base_col = F.col(base) if base in items.columns else F.lit("")

    def finished(f: Column) -> Column:
        raw = F.try_element_at("data", f["name"])
        value = F.aggregate(f["transform"], raw, lambda v, step: _step_done(F.trim(step), v, base_col))
        linked = let(value, lambda v: F.when(is_link_name_column(f["name"]), absolutize(v, base_col)).otherwise(v))
        return F.struct(f["name"].alias("key"), linked.alias("value"), f["required"].alias("required"))

    d = d.withColumn("_done", F.transform("_fields", finished))
    lacks = F.exists("_done", lambda e: e["required"] & (F.coalesce(T.strip(e["value"]), F.lit("")) == ""))
    d = d.where(~lacks)
    first = F.filter("_done", lambda e, i: ~F.exists(F.slice("_done", F.lit(1), i), lambda x: x["key"] == e["key"]))
    data = F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"], e["value"])))
    return d.select(*[data.alias("data") if c == "data" else F.col(c) for c in items.columns])


def check_fields(items: DataFrame, rules: DataFrame, analysed: DataFrame) -> DataFrame:
    """``rule_id, pos, name, selector, attribute, filled, replaced`` of the fields that every rule should go on with.

    A field that is empty in all items of its rule takes the analysed selector of its
    name (``analysed``: rule_id, name, selector, attribute). Of fields that have the same
    value in every item one stays: the first with a usual name, else the first. One
    grouping over all items of all rules: columns are compared by sums of row hashes.
    Rules without items keep their fields.
    """
    cells = items.select("rule_id", "page_id", "item_id", F.explode("data").alias("name", "value"))
    value = F.coalesce("value", F.lit(""))
    row_hash = lambda salt: F.sum(F.xxhash64(F.lit(salt), "page_id", "item_id", value).cast("decimal(20,0)"))
    seen = cells.groupBy("rule_id", "name").agg(
        F.count_if(T.strip(value) != "").alias("filled"), F.count("*").alias("n"), row_hash(1).alias("h1"), row_hash(2).alias("h2"))
    fields = rules.select("rule_id", F.posexplode("list_rule.fields").alias("pos", "f")).select("rule_id", "pos", "f.name", "f.selector", "f.attribute")
    other = analysed.groupBy("rule_id", "name").agg(F.min(F.struct("selector", "attribute")).alias("other"))
    d = fields.join(seen, ["rule_id", "name"], "left").join(other, ["rule_id", "name"], "left")
    usual = F.lower("name").isin(*PRIMARY_NAMES)
    same = Window.partitionBy("rule_id", "h1", "h2", "n", F.when(F.coalesce("filled", F.lit(0)) == 0, F.col("pos"))).orderBy(F.when(usual, 0).otherwise(1), "pos")
    d = d.withColumn("_nth", F.row_number().over(same)).where((F.col("_nth") == 1) | F.col("h1").isNull())
    swap = (F.col("filled") == 0) & F.col("other").isNotNull() & (F.col("other.selector") != F.col("selector"))
    swap = F.coalesce(swap, F.lit(False))
    return d.select(
        "rule_id", "pos", "name", F.when(swap, F.col("other.selector")).otherwise(F.col("selector")).alias("selector"),
        F.when(swap, F.coalesce("other.attribute", "attribute")).otherwise(F.col("attribute")).alias("attribute"),
        F.coalesce("filled", F.lit(0)).alias("filled"), swap.alias("replaced"),
    )


def check_pagination(nodes: DataFrame, rules: DataFrame, paging: DataFrame) -> DataFrame:
    """``page_id, rule_id, next_selector, hits`` per page and rule of its site.

    The rule's selector if it hits on that page, else the analysed one
    (``paging``: page_id, next_selector), else null; a rule that names none has none.
    """
    pages = nodes.select("page_id", "site").distinct()
    hits = match_rules(nodes, rules.withColumn("list_rule", F.col("list_rule").withField("fields", F.filter("list_rule.fields", lambda f: F.lit(False)))))
    hits = hits.where("role = 'next'").groupBy("page_id", "rule_id").agg(F.count_distinct("node_id").alias("hits"))
    d = pages.join(rules.select("site", "rule_id", F.col("pagination.next_selector").alias("own")), "site").join(hits.hint("merge"), ["page_id", "rule_id"], "left")
    d = d.join(paging.select("page_id", F.col("next_selector").alias("analysed")), "page_id", "left")
    n = F.coalesce("hits", F.lit(0))
    return d.select("page_id", "rule_id", F.when(F.col("own").isNotNull(), F.when(n > 0, F.col("own")).otherwise(F.col("analysed"))).alias("next_selector"), n.alias("hits"))
