"""Removal of repeated passages by overlapping windows of three lines.

Every three consecutive lines that are not blank form a window. Windows are
hashed, the first occurrence of each hash in (document, position) order is
kept, and the lines that later occurrences cover are taken out of their texts.
Overlapping occurrences cover one merged stretch.

Why nothing is lost: a removed line equals the line at the same offset of the
window's first occurrence, which lies earlier; following that step ends at a
line that is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.llm.common import saved

WINDOW = 3
BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def window_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """One row per window: key, number of the window, the places of its lines, 128-bit hash.

    With *short*, all lines of a text of one or two lines that are not blank are a window too.
    """
    marked = F.filter(
        F.transform(_lines(F.col(text)), lambda line, i: F.struct(F.md5(F.trim(line, F.lit(BLANKS))).alias("h"), i.alias("i"))),
        lambda s: s["h"] != F.md5(F.lit("")),
    )
    d = docs.select(F.col(key).alias("doc_id"), marked.alias("m"))
    later = [F.slice("m", 1 + j, F.greatest(F.size("m") - (WINDOW - 1), F.lit(0))) for j in range(WINDOW)]
    windows = F.transform(
        F.arrays_zip(*[a.alias(f"l{j}") for j, a in enumerate(later)]),
        lambda z: F.struct(
            F.array(*[z[f"l{j}"]["i"] for j in range(WINDOW)]).alias("lines"),
            F.unhex(F.md5(F.concat(*[z[f"l{j}"]["h"] for j in range(WINDOW)]))).alias("hash"),
        ),
    )
    if short:
        whole = F.struct(F.transform("m", lambda s: s["i"]).alias("lines"), F.unhex(F.md5(F.array_join(F.transform("m", lambda s: s["h"]), ""))).alias("hash"))
        windows = F.when(F.size("m") >= WINDOW, windows).otherwise(F.array(whole))
    d = d.where(F.size("m") >= (1 if short else WINDOW)).select("doc_id", F.posexplode(windows).alias("k", "w"))
    return d.select("doc_id", "k", "w.lines", "w.hash")


def covered_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """``(doc_id, covered)``: the places of the lines that later occurrences cover.

    A hash that occurs in a third of all documents is reduced to one row per map
    task before the first shuffle. Only hashes that repeat are kept; joining
    them back is a plain equi-join of two written tables, which Spark broadcasts
    or splits where a key is hot.
    """
    rows = saved(window_rows(docs, key, text, short))
    place = F.struct("doc_id", "k")
    firsts = rows.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = saved(firsts.select("hash", "first"))
    later = rows.join(firsts, "hash").where(place > F.col("first"))
    return later.groupBy("doc_id").agg(F.flatten(F.collect_set("lines")).alias("covered"))


def cleaned_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """``row, text, n_lines, n_removed`` per row of *docs*: the row as a struct, its text without repeated passages, counts."""
    hits = covered_lines(docs, key, text, short).select(F.col("doc_id").alias("_id"), "covered")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    d = d.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("row", "text", "covered", _lines(F.col("text")).alias("lines"))
    n = F.size("lines")
    rest = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("covered", F.array().cast("array<int>")))
    d = d.select("row", "text", "covered", "lines", rest.alias("rest"))
    kept = F.array_join(F.transform("rest", lambda i: F.get(F.col("lines"), i)), "\n")
    return d.select(
        "row", F.when(F.col("covered").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col("covered").isNull() | F.col("text").isNull(), 0).otherwise(n - F.size("rest")).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """*docs* with repeated passages removed from the text; adds ``n_lines`` and ``n_removed``.

    Lines are compared without blanks at their ends; blank lines are part of no
    window and stay. A null text stays null and counts no lines. Texts of fewer
    than three lines stay as they are unless *short* is set; then those that
    repeat an earlier short text become blank. Rows with equal key (or null key) are
    taken for the same document: none of them is the later one, and what is
    removed from one is removed from all. Other columns pass unchanged, but
    ones named like the two new columns are replaced.
    """
    d = cleaned_texts(docs, key, text, short)
    kept = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return d.select(*kept, "n_lines", "n_removed")


def line_dedup_sql(docs: str = "documents") -> str:
    """DuckDB: ``doc_id, text, n_lines, n_removed`` of :func:`dedup_lines`, with the windows spelled out in full."""
    blanks = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    return f"""
    WITH l AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
      FROM {docs} WHERE text IS NOT NULL),
    s AS (SELECT doc_id, i, trim(line, {blanks}) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
          FROM l WHERE trim(line, {blanks}) <> ''),
    w AS (SELECT a.doc_id, a.k, a.t || chr(10) || b.t || chr(10) || c.t AS win, a.i AS i0, b.i AS i1, c.i AS i2
          FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN s c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS rn FROM w),
    gone AS (SELECT DISTINCT doc_id, unnest([i0, i1, i2]) AS i FROM r WHERE rn > 1),
    kept AS (SELECT l.doc_id, string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i) AS text,
                    count(*) AS n_lines, count(g.i) AS n_removed
             FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY 1)
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
           CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
    FROM {docs} d LEFT JOIN kept k ON d.doc_id = k.doc_id"""
