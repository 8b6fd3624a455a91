"""Checking and completing rules against what was analysed."""

from __future__ import annotations

from dataclasses import replace
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.operators import selectors as S
from webframe.operators.rules import Rule
from webframe.operators.structure import PRIMARY_NAMES, looks_generated_name


def merge_fields(rule_fields: DataFrame, analysed: DataFrame, key: str = "rule_id") -> DataFrame:
    """Fields of rules plus analysed fields they lack, by name and by selector and attribute.

    Only rules whose source starts with "ai" are completed.
    """
    attr = F.coalesce("attribute", F.lit(""))
    ai = rule_fields.where(F.col("source").startswith("ai")).select(key).distinct()
    new = analysed.where(~looks_generated_name("name")).join(ai, key, "left_semi")
    new = new.join(rule_fields.select(key, "name"), [key, "name"], "left_anti")
    have = rule_fields.select(key, "selector", attr.alias("_a"))
    new = new.withColumn("_a", attr).join(have, [key, "selector", "_a"], "left_anti").drop("_a")
    return rule_fields.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)), allowMissingColumns=True)


def validate_fields(rows: DataFrame, rule: Rule, analysed: dict[str, tuple[str, str | None]]) -> Rule:
    """Replace fields empty in all rows, then drop columns that repeat another one.

    One aggregate over the rows returns a count per column and per column pair
    (a rule has a dozen columns at most); no column leaves the executors.
    """
    names = [f.name for f in rule.fields]
    text = {n: F.coalesce(F.trim(F.col(n).cast("string")), F.lit("")) for n in names}
    raw = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names}
    pairs = list(combinations(range(len(names)), 2))
    got = rows.agg(
        F.count("*").alias("total"),
        *[F.count_if(text[n] != "").alias(f"n{i}") for i, n in enumerate(names)],
        *[F.count_if(raw[names[i]] == raw[names[j]]).alias(f"p{i}_{j}") for i, j in pairs],
    ).first()
    total = got["total"]
    if not total:
        return rule
    fields, filled = list(rule.fields), [got[f"n{i}"] for i in range(len(names))]
    for i, f in enumerate(fields):
        other = analysed.get(f.name)
        if not filled[i] and other and other[0] != f.selector:
            fields[i] = replace(f, selector=other[0], attribute=other[1] if other[1] is not None else f.attribute)
    gone: set[int] = set()
    for i, j in pairs:
        if i in gone or j in gone or not filled[i] or got[f"p{i}_{j}"] != total:
            continue
        first_is_main = names[i].lower() in PRIMARY_NAMES or names[j].lower() not in PRIMARY_NAMES
        gone.add(j if first_is_main else i)
    return replace(rule, fields=tuple(f for i, f in enumerate(fields) if i not in gone))


def validate_pagination(pages: DataFrame, nodes: DataFrame, rule: Rule, paging: DataFrame) -> DataFrame:
    """Next selector to use per page: the rule's when it hits, else the analysed one, else none."""
    found = paging.select("page_id", F.col("next_selector").alias("analysed"))
    base = pages.select("page_id").join(found, "page_id", "left")
    if not rule.next_selector:
        return base.select("page_id", F.lit(None).cast("string").alias("next_selector"), F.lit(0).alias("hits"))
    try:
        hits = S.select_nodes(nodes, rule.next_selector).groupBy("page_id").agg(F.count("*").alias("hits"))
    except S.SelectorError:
        return base.select("page_id", F.col("analysed").alias("next_selector"), F.lit(0).alias("hits"))
    d = base.join(hits, "page_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return d.select("page_id", F.when(F.col("hits") > 0, F.lit(rule.next_selector)).otherwise(F.col("analysed")).alias("next_selector"), "hits")
