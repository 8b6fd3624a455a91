"""Chains of user steps, and user row functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webframe.functions.jsonpath import _as_text, _deep_values, tokens


@dataclass
class Step:
    """``run(df, config)`` returns the new DataFrame, or None to leave it as it is."""

    id: str
    run: Callable[[DataFrame, dict], DataFrame | None]
    config: dict = field(default_factory=dict)


@dataclass
class Outcome:
    df: DataFrame
    used: list[str]
    errors: list[str]


def run_steps(df: DataFrame, steps: Sequence[Step], only: Sequence[str] | None = None) -> Outcome:
    """Apply steps in order; one that fails to plan is noted and skipped.

    Steps are plan transformations. Errors that only show while rows are
    computed are not isolated here: use ``try_*`` functions, or ``row_step``.
    """
    used, errors = [], []
    for step in steps:
        if only is not None and step.id not in only:
            continue
        try:
            out = step.run(df, step.config)
            if isinstance(out, DataFrame):
                out.schema  # noqa: B018 - resolve now, so a bad plan fails in its own step
                df = out
            used.append(step.id)
        except (PySparkException, ValueError, TypeError, KeyError, AttributeError) as exc:
            errors.append(f"{step.id}: {type(exc).__name__}: {str(exc).splitlines()[0]}")
    return Outcome(df, used, errors)


def row_step(fn: Callable[[dict], dict], schema: str | StructType) -> Callable[[DataFrame, dict], DataFrame]:
    """A step from a function on one row; a failing row keeps NULLs and says why in ``_error``."""

    def run(df: DataFrame, config: dict) -> DataFrame:
        out_schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        names = out_schema.fieldNames()

        def apply(batches):
            for pdf in batches:
                rows = []
                for rec in pdf.to_dict("records"):
                    try:
                        new = fn(rec)
                        rows.append({**{n: new.get(n) for n in names}, "_error": None})
                    except Exception as exc:
                        rows.append({**{n: rec.get(n) for n in names}, "_error": f"{type(exc).__name__}: {exc}"})
                yield pd.DataFrame(rows, columns=[*names, "_error"])

        return df.mapInPandas(apply, StructType(out_schema.fields).add("_error", "string"))

    return run


def _walk(node, steps: list) -> list:
    """Values of a parsed JSON document along path steps."""
    cur = [node]
    for kind, arg in steps:
        nxt: list = []
        for v in cur:
            if kind == "key" and isinstance(v, dict) and arg in v:
                nxt.append(v[arg])
            elif kind == "index" and isinstance(v, list) and -len(v) <= arg < len(v):
                nxt.append(v[arg])
            elif kind == "star" and isinstance(v, (list, dict)):
                nxt.extend(v if isinstance(v, list) else v.values())
            elif kind == "deep":
                _deep_values(v, arg, nxt)
        cur = nxt
    return cur


class JsonPathRows:
    """Table function: one row per match of a JSONPath that may itself be a column."""

    def eval(self, text: str, expr: str):
        try:
            doc = json.loads(text)
        except (TypeError, ValueError):
            return
        for i, v in enumerate(_walk(doc, tokens(expr or ""))):
            yield i, _as_text(v)


def register_jsonpath_rows(spark: SparkSession, name: str = "jsonpath_rows") -> None:
    """``SELECT .. FROM t, LATERAL jsonpath_rows(t.body, '$..price')``"""
    spark.udtf.register(name, F.udtf(JsonPathRows, returnType="pos int, value string"))
