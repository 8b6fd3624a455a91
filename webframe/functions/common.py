"""Small building blocks shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind *value* once for *body*.

    Columns are trees: using a long expression five times writes it five times
    into the plan, and nesting such functions grows the plan exponentially. A
    one-element ``transform`` gives the value a name instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
