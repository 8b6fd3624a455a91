"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ten consecutive words of a benchmark item (all words of a shorter
one). A document contains a window only if it contains each of its words, so it
is enough to join on a prefix of one: the word that is rarest in the corpus.
The offset of that word within its window gives the only place at which the
window can lie around each of its occurrences; windows that would begin before
the first or end after the last word are dropped, and the others are compared
word by word.

1. count, over the whole corpus, the words that occur in the benchmark;
2. keep per distinct window its rarest word; windows with a word that never
   occurs in the corpus are dropped;
3. join the words of the documents with these words, check bounds and words.

Step 3 streams each document once and needs no shuffle of texts while the
windows are small enough to broadcast (checked against ``broadcast_bytes``).
Beyond that the documents are cut into overlapping segments and everything is
shuffled by equi-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webframe.llm.common import ascii_lower, saved

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20
SEGMENT = 512


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(item_id, window_id, words)``: the distinct windows of every item; the id is a 128-bit hash of the words."""
    w = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    w = w.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), size).alias("words"))
    return w.withColumn("window_id", F.md5(F.concat_ws(" ", "words"))).distinct()


def rarest_words(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``(window_id, words, n, word, off)``: every window that can occur, with its rarest word and that word's offset."""
    places = windows.select("window_id", "words").dropDuplicates(["window_id"]).select("window_id", "words", F.posexplode("words").alias("off", "word"))
    vocabulary = saved(places.select("word").distinct())
    counts = docs.select(F.explode(words_of(F.col("text"))).alias("word")).join(vocabulary, "word").groupBy("word").count()
    ranked = places.join(counts, "word", "left").groupBy("window_id").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word", "off")).alias("rare"),
        F.first("words").alias("words"),
    )
    return ranked.where("rare.count > 0").select("window_id", "words", F.size("words").alias("n"), "rare.word", "rare.off")


def _found(at: Column, words: Column) -> Column:
    """The window lies at word *at* (from 0) of *words*: bounds first, then all of its words."""
    return (at >= 0) & (at + F.col("n") <= F.size(words)) & (F.slice(words, at + 1, F.col("n")) == F.col("window_words"))


def _by_broadcast(docs: DataFrame, rare: DataFrame) -> DataFrame:
    d = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    d = d.select("doc_id", "words", F.posexplode("words").alias("pos", "word"))
    start = F.col("pos") - F.col("off")
    hit = d.join(F.broadcast(rare), "word").where(_found(start, F.col("words")))
    return hit.select("doc_id", start.alias("start"), "n", "window_id")


def _by_shuffle(docs: DataFrame, rare: DataFrame, size: int) -> DataFrame:
    """Same rows; a segment holds the windows that start in its first ``SEGMENT`` words."""
    d = docs.select("doc_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    d = d.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(SEGMENT))).alias("seg"))
    segments = saved(d.select("doc_id", "seg", F.slice("w", F.col("seg") + 1, SEGMENT + size - 1).alias("words")))
    tokens = segments.select("doc_id", "seg", F.posexplode("words").alias("pos", "word"))
    near = tokens.join(rare.select("word", "off", "n", "window_id"), "word").withColumn("at", F.col("pos") - F.col("off"))
    near = near.where((F.col("at") >= 0) & (F.col("at") < SEGMENT)).select("doc_id", "seg", "at", "n", "window_id")
    near = near.join(rare.select("window_id", "window_words"), "window_id")
    s = segments.select(F.col("doc_id").alias("_d"), F.col("seg").alias("_s"), "words")
    hit = near.join(s, near["doc_id"].eqNullSafe(s["_d"]) & (near["seg"] == s["_s"])).where(_found(F.col("at"), F.col("words")))
    return hit.select("doc_id", (F.col("seg") + F.col("at")).alias("start"), "n", "window_id")


def occurrences(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, start, n, window_id)`` of every occurrence of a window, and the windows of the items."""
    windows = saved(windows_of(items, size))
    rare = saved(rarest_words(docs, windows).withColumnRenamed("words", "window_words"))
    weight = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.concat_ws(" ", "window_words")), F.lit(0)), F.lit(160)])
    total = rare.agg(F.sum(weight)).first()[0] or 0
    found = _by_broadcast(docs, rare) if total <= broadcast_bytes else _by_shuffle(docs, rare, size)
    return saved(found.distinct()), windows


def decontaminate(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, item_ids, contaminated`` per row of *docs*.

    ``n_hit`` counts the words that lie in any occurrence, each once; ``item_ids``
    are the items with occurring windows as strings in string order. Null and
    empty texts have no words; an item without words has no window, and a null
    item id names no item. Rows with equal doc_id count as one document: each
    gets the hits of all. Only ``doc_id``, ``text`` and ``item_id`` are read, so
    other columns cannot clash.
    """
    docs = docs.select("doc_id", "text")
    found, windows = occurrences(docs, items.select("item_id", "text"), size, broadcast_bytes)
    spans = found.groupBy("doc_id", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    hits = spans.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("doc_id").agg(F.sum("fresh").alias("n_hit"))
    named = found.select("doc_id", "window_id").distinct().join(windows.select("window_id", "item_id"), "window_id")
    named = named.where(F.col("item_id").isNotNull()).select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    hits = hits.join(named.withColumnRenamed("doc_id", "_n"), F.col("doc_id").eqNullSafe(F.col("_n")), "left").drop("_n")
    hits = hits.withColumnRenamed("doc_id", "_id")
    d = docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    d = d.join(hits, d["doc_id"].eqNullSafe(hits["_id"]), "left")
    none = F.array().cast("array<string>")
    return d.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate_sql(docs: str = "documents", items: str = "benchmark", size: int = WINDOW) -> str:
    """DuckDB: columns of the registered query, by joining every window at every place."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce({words}, []) AS w FROM {docs}),
    b AS (SELECT item_id, {words} AS w FROM {items}),
    v AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {size - 1}, 1))) AS s FROM b WHERE len(w) > 0),
    wins AS (SELECT DISTINCT item_id, w[s:s + {size - 1}] AS win FROM v),
    sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
    p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS s FROM d WHERE len(w) > 0),
    hit AS (SELECT DISTINCT p.doc_id, p.s, n, item_id
            FROM p JOIN sizes ON p.s + n - 1 <= len(p.w) JOIN wins ON wins.win = p.w[p.s:p.s + n - 1]),
    marks AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
              FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS pos FROM hit) GROUP BY 1),
    names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN names USING (doc_id)"""
