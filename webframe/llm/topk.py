"""Exact top-k inner-product search with a three-phase uniform threshold.

The components of the vectors are cut into ``LISTS`` blocks; each block scores
every candidate locally, and a candidate's score is the sum over the lists.

1. *Gather*: in every pair of a query block and a candidate block the ``k`` best
   candidates of each list are taken, with their whole scores, which their rows
   hold. The k-th best whole score gathered for a query is a safe cutoff: its
   true k-th best is at least that.
2. *Broadcast and collect*: the cutoffs go back to all pairs of blocks. Scores
   that reach a cutoff t have some list that scores at least t / LISTS, so only
   candidates with such a local score are sufficient to go on with.
3. *Resolve*: the whole scores of these are computed exactly, the ones that
   reach the cutoff are ranked, ties to the smaller id.

Queries and candidates meet block by block, each block of a fixed number of
rows, so no task holds more than two blocks, whatever the size of the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webframe.llm.common import saved

LISTS = 4
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: Sums below this are exact in doubles; the matrices then go through the fast product.
EXACT = 1 << 53
LONG = (1 << 63) - 1


def quantized(vector: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` of each component as a long (at most the range of int); null for vectors that take no part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    usable = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(usable, whole)


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows: in doubles where they hold every sum, else in longs, else in Python's integers."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < LONG:
        return a @ b.T
    whole = a.astype(object) @ b.T.astype(object)
    return np.clip(whole, -LONG - 1, LONG).astype(np.int64)


def _block(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]:
    width = max((len(v) for v in pdf["v"]), default=0)
    q, c = pdf[pdf["asks"]], pdf[~pdf["asks"]]
    return q, c, _matrix(q["v"], width), _matrix(c["v"], width)


def _cuts(width: int) -> list[slice]:
    edges = np.linspace(0, width, min(LISTS, max(width, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


_PAIR = "query_id long, vec_id long, score long"


def _gather(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Phase 1 for one pair of blocks: the best k of each list, with whole scores."""
    q, c, a, b = _block(pdf)
    if not len(q) or not len(c):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    own = q["vec_id"].to_numpy()[:, None] == c["vec_id"].to_numpy()[None, :]
    whole, picked = _product(a, b), np.zeros((len(q), len(c)), bool)
    for part in _cuts(a.shape[1]):
        local = _product(a[:, part], b[:, part])
        local[own] = -LONG - 1
        best = np.argpartition(local, len(c) - k, axis=1)[:, -k:] if k < len(c) else np.tile(np.arange(len(c)), (len(q), 1))
        np.put_along_axis(picked, best, True, axis=1)
    i, j = np.nonzero(picked & ~own)
    return _best(q["vec_id"].to_numpy()[i], c["vec_id"].to_numpy()[j], whole[i, j], k)


def _collect(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Phases 2 and 3 for one pair of blocks: candidates with a sufficient local score, resolved exactly."""
    q, c, a, b = _block(pdf)
    if not len(q) or not len(c):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    cutoff = q["cutoff"].to_numpy(dtype=object)
    cutoff = np.array([-LONG - 1 if pd.isna(x) else int(x) for x in cutoff], np.int64)[:, None]
    parts = _cuts(a.shape[1])
    least = cutoff // len(parts) + (cutoff % len(parts) > 0)  # rounded up
    enough = np.zeros((len(q), len(c)), bool)
    for part in parts:
        enough |= _product(a[:, part], b[:, part]) >= least
    enough &= q["vec_id"].to_numpy()[:, None] != c["vec_id"].to_numpy()[None, :]
    i, j = np.nonzero(enough)
    score = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 18):
        s = slice(at, at + (1 << 18))
        x, y = a[i[s]], b[j[s]]
        top = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * a.shape[1]
        score[s] = np.einsum("ij,ij->i", x, y) if top < LONG else [
            max(-LONG - 1, min(LONG, sum(int(m) * int(n) for m, n in zip(u, w, strict=True)))) for u, w in zip(x, y, strict=True)
        ]
    reach = score >= cutoff[i, 0]
    return _best(q["vec_id"].to_numpy()[i[reach]], c["vec_id"].to_numpy()[j[reach]], score[reach], k)


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    """At most k entries of each query go on: those that this pair of blocks alone ranks first."""
    d = pd.DataFrame({"query_id": query, "vec_id": vec, "score": score}, dtype="int64")
    d = d.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return d[d.groupby("query_id").cumcount() < k]


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))


def top_k(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``queries`` holds, the k best other rows.

    Vectors that are null or hold a null or non-finite component, and rows with
    null id, take no part. Vectors of unequal length are compared as if filled
    with zeros; scores beyond a long are held at its ends. Rows with the query's
    id are its own; repeated rows of another id are candidates each. Ties go to
    the smaller id. Other columns are not read.
    """
    d = vectors.select(F.col(key).cast("long").alias("vec_id"), quantized(F.col(vector), scale).alias("v"), queries.alias("asks"))
    d = d.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    d = saved(d.withColumn("place", F.monotonically_increasing_id()))  # written, so that it stays the same from here on
    asking = d.where("asks").select("vec_id", "v").dropDuplicates(["vec_id"])
    n, m = d.count(), asking.count()
    rows, columns = max(1, -(-m // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))

    def met(cutoffs: DataFrame | None) -> DataFrame:
        """All pairs of blocks: queries once for each block of candidates, candidates once for each block of queries."""
        q = asking if cutoffs is None else asking.join(cutoffs, "vec_id", "left")
        cutoff = F.lit(None).cast("long") if cutoffs is None else F.col("cutoff")
        q = q.select(
            F.pmod(F.xxhash64("vec_id"), F.lit(rows)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"),
            "vec_id", "v", F.lit(True).alias("asks"), cutoff.alias("cutoff"),
        )
        spread = F.pmod(F.xxhash64("vec_id", "place"), F.lit(columns)).cast("int")
        c = d.select("vec_id", "v", spread.alias("j")).select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("i"), "j", "vec_id", "v",
            F.lit(False).alias("asks"), F.lit(None).cast("long").alias("cutoff"),
        )
        return q.unionByName(c)

    local = met(None).groupBy("i", "j").applyInPandas(lambda pdf: _gather(pdf, k), _PAIR)
    gathered = saved(local.withColumn("rank", _rank()).where(F.col("rank") <= k))
    cutoffs = gathered.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("cutoff")).withColumnRenamed("query_id", "vec_id")
    found = met(saved(cutoffs)).groupBy("i", "j").applyInPandas(lambda pdf: _collect(pdf, k), _PAIR)
    return found.withColumn("rank", _rank()).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_sql(table: str = "embeddings", every: int = 20, k: int = 20) -> str:
    """DuckDB: the same rows, from the scores of all pairs."""
    return f"""
    WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM {table}
               WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""
