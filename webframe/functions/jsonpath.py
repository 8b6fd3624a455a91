"""A small JSONPath over JSON text columns.

Keys, indexes, negative indexes and ``[*]`` are Columns; only the recursive
``..key`` needs an Arrow worker. Values come back as text: JSON text for
objects and lists, plain text for scalars.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_EMPTY = "array<string>"


def _is_name(c: str, first: bool) -> bool:
    ideograph = "\u4e00" <= c <= "\u9fff"
    return ideograph or c == "_" or (c.isascii() and c.isalpha()) or (not first and (c == "-" or c.isalnum()))


def _name_end(body: str, at: int) -> int:
    """Where the name that begins at *at* ends; *at* itself if none begins there."""
    end = at
    while end < len(body) and _is_name(body[end], end == at):
        end += 1
    return end


def _bracket(inner: str) -> tuple[str, object] | None:
    """Step for the text between brackets; None if it is none."""
    inner = inner.strip()
    if inner == "*":
        return "star", None
    if inner.removeprefix("-").isdecimal():
        return "index", int(inner)
    for quote in "'\"":
        if len(inner) >= 2 and inner[0] == inner[-1] == quote and quote not in inner[1:-1]:
            return "key", inner[1:-1]
    return None


def tokens(expr: str) -> list[tuple[str, object]]:
    """Steps of a path; characters that fit no step are skipped, a bare name is a key."""
    body = expr.strip().removeprefix("$")
    out: list[tuple[str, object]] = []
    at = 0
    while at < len(body):
        step, after = None, at + 1
        if body[at] == ".":
            dots = 2 if body.startswith("..", at) else 1
            end = _name_end(body, at + dots)
            if end > at + dots:
                step, after = ("deep" if dots == 2 else "key", body[at + dots:end]), end
        elif body[at] == "[":
            quote = body[at + 1:].lstrip()[:1]
            close = body.find("]", body.find(quote, body.find(quote, at) + 1) if quote in ("'", '"') else at)
            if close > at:
                step = _bracket(body[at + 1:close])
                after = close + 1 if step else after
        if step:
            out.append(step)
        at = after
    if not out and body.strip():
        return [("key", body.strip())]
    return out


def _deep_values(node, key: str, out: list) -> None:
    stack = [node]
    while stack:
        cur = stack.pop()
        if isinstance(cur, dict):
            if key in cur:
                out.append(cur[key])
            stack.extend(reversed(list(cur.values())))
        elif isinstance(cur, list):
            stack.extend(reversed(cur))


def _as_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _deep_udf(key: str):
    @F.pandas_udf(ArrayType(StringType()))
    def find(lists: pd.Series) -> pd.Series:
        def one(texts):
            out: list = []
            for t in texts if texts is not None else ():
                try:
                    _deep_values(json.loads(t), key, out)
                except (TypeError, ValueError):
                    continue
            return [_as_text(v) for v in out]

        return lists.map(one)

    return find


def _children(e: Column) -> Column:
    return F.coalesce(
        F.when(e.startswith("["), F.from_json(e, "array<string>")),
        F.when(e.startswith("{"), F.map_values(F.from_json(e, "map<string,string>"))),
        F.array().cast(_EMPTY),
    )


def _from_end(n: int):
    return lambda e: F.try_element_at(F.when(e.startswith("["), F.from_json(e, "array<string>")), F.lit(n))


def jsonpath(c, expr: str) -> Column:
    """All matches as ``array<string>`` in document order; no match is an empty array."""
    c = F.col(c) if isinstance(c, str) else c
    cur = F.array(c)
    pending = ""

    def flush(cur: Column) -> Column:
        if not pending:
            return cur
        path = "$" + pending
        return F.array_compact(F.transform(cur, lambda e: F.get_json_object(e, path)))

    for kind, arg in tokens(expr):
        if kind == "key":
            if "'" in arg:
                raise ValueError(f"key {arg!r} with a quote is not supported")
            pending += f"['{arg}']"
        elif kind == "index" and arg >= 0:
            pending += f"[{arg}]"
        else:
            cur, pending = flush(cur), ""
            if kind == "index":
                cur = F.array_compact(F.transform(cur, _from_end(arg)))
            elif kind == "star":
                cur = F.flatten(F.transform(cur, _children))
            else:
                cur = _deep_udf(arg)(cur)
    return F.when(c.isNull(), F.array().cast(_EMPTY)).otherwise(flush(cur))


def first_value(c, expr: str) -> Column:
    return F.get(jsonpath(c, expr), F.lit(0))


def flatten_json(c, list_items: bool = True) -> Column:
    """Leaves of a JSON text as ``array<struct<path, value>>`` of any depth (Arrow worker).

    ``list_items`` walks lists as ``name[i]``; without it a list is one leaf.
    """

    @F.pandas_udf("array<struct<path:string,value:string,is_text:boolean>>")
    def leaves(texts: pd.Series) -> pd.Series:
        def one(t):
            out: list = []
            try:
                stack = [("", json.loads(t))]
            except (TypeError, ValueError):
                return out
            while stack:
                path, node = stack.pop()
                if isinstance(node, dict):
                    stack.extend((f"{path}.{k}" if path else str(k), v) for k, v in reversed(list(node.items())))
                elif isinstance(node, list) and list_items:
                    stack.extend((f"{path}[{i}]", node[i]) for i in range(len(node) - 1, -1, -1))
                else:
                    out.append({"path": path, "value": _as_text(node), "is_text": isinstance(node, str)})
            return out

        return texts.map(one)

    return leaves(F.col(c) if isinstance(c, str) else c)
