"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node of its component.

    Large star: every node sends its larger neighbours to its smallest
    neighbour. Small star: every node sends its smaller neighbours to the
    smallest of them. Both keep components, and repeated they end with one star
    for each. A node with very many neighbours is no hot task: its minimum is an
    aggregate with partial sums, and the join that hands it back is one that
    Spark splits. Each round is written to the shared folder, so a lost executor
    repeats one round at most; the number of rounds grows with the logarithm of
    the graph's size.
    """
    e = saved(_tidy(edges.select("a", "b")))
    while True:
        e = saved(_tidy(_star(_both(e), larger=True)))
        following = saved(_tidy(_star(e.select(F.col("b").alias("u"), F.col("a").alias("v")), larger=False)))
        parents = following.groupBy("b").agg(F.countDistinct("a").alias("n"))
        split = parents.where("n > 1").limit(1).count()
        chained = following.select("a").distinct().join(following.select("b").distinct(), F.col("a") == F.col("b")).limit(1).count()
        e = following
        if not split and not chained:
            break
    roots = e.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)


def _tidy(edges: DataFrame) -> DataFrame:
    """Edges from the smaller to the larger end, each once."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    return edges.where(F.col("a") != F.col("b")).select(a.alias("a"), b.alias("b")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """From ``(u, v)``: v joined to the smallest of u and its neighbours; ``larger`` takes v > u only."""
    pairs = saved(pairs)
    smallest = saved(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    linked = pairs.join(smallest, "u")
    if larger:
        return linked.where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    to_node = smallest.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return linked.select(F.col("m").alias("a"), F.col("v").alias("b")).union(to_node)
