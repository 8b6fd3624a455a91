"""Removal of repeated word windows, found by recompression.

1. Every text is recompressed (:mod:`webframe.llm.recompression`): rounds name runs
   and pairs of words with digests that all tasks agree on. Each window gets one
   symbol inside it as its anchor, so equal windows have equal anchors; windows
   with one anchor form a stretch. Only anchors and places are written.
2. One global count says which anchors repeat. All other stretches are done with:
   no window of theirs occurs twice.
3. The texts of the others are read again for digests of whole stretches and of
   their windows. Of equal stretches all but the first are covered: this takes
   whole copies, however many, at one row per stretch and with partial minima.
4. Where first stretches of different content share an anchor, their windows are
   verified one by one in the same way: the first place of each window's digest.
5. The covered words are taken out of the texts.

No step pairs occurrences, so a passage in a third of all texts costs what any
other costs. Texts cross a shuffle twice, compressed. Two stretches or windows are
taken for equal if two independent digests of 64 bits are: that of the anchor's
words and that of all their words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.llm.common import saved
from webframe.llm.recompression import PIECE, stretches, word_digests
from webframe.plans.lineage import release

WINDOW = 20
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _blocks(texts: Iterator[bytes], size: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Texts joined to about ``PIECE`` bytes: (row, words before it) of each part, and the parts.

    A longer text is cut before a space; a part but the first repeats the last ``size - 1`` words of the one before.
    """
    parts: list[tuple[int, int]] = []
    block: list[bytes] = []
    held = 0
    for row, text in enumerate(texts):
        at, before = 0, 0
        while True:
            end, own = len(text), []
            reach = at + PIECE
            while len(text) - at > 2 * PIECE:
                found = _BREAK.search(text, reach)
                end = found.start() if found else len(text)
                own = text[at:end].split()
                if len(own) >= 2 * size or end == len(text):
                    break
                reach = end + PIECE
            parts.append((row, before))
            block.append(text[at:end])
            held += end - at
            if held >= PIECE:
                yield parts, block
                parts, block, held = [], [], 0
            if end == len(text):
                break
            tail = own[len(own) - size + 1:]
            before += len(own) - len(tail)
            at = end
            for word in reversed(tail):  # back to the first of the words that are read again
                at = text.rindex(word, 0, at)
    if block:
        yield parts, block


def _found(texts: Iterator[bytes], size: int):
    """For each block: row, place in the text and place in the block of each stretch, windows, anchor, key, digests."""
    for parts, block in _blocks(texts, size):
        begins = np.cumsum([0, *map(len, block)])[:-1]
        start, _, text, lanes = word_digests(np.frombuffer(b"".join(block), np.uint8), begins)
        # words in a row, with a border after each text
        n = len(start) + len(block)
        place = np.arange(len(start)) + text
        border = np.ones(n, bool)
        border[place] = False
        spread = []
        for lane in lanes:
            spread.append(np.zeros(n, np.uint64))
            spread[-1][place] = lane
        first, count, anchor, key, digests = stretches(tuple(spread), border, size)
        opens = np.concatenate([[0], np.flatnonzero(border)[:-1] + 1])
        part = np.searchsorted(opens, first, "right") - 1
        rows, offsets = (np.array([p[k] for p in parts], np.int64) for k in (0, 1))
        yield rows[part], first - opens[part] + offsets[part], first, count, anchor, key, digests


def _bytes_of(column: pa.Array) -> Iterator[bytes]:
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.cast(pa.binary()))


def _anchors(d: DataFrame, size: int) -> DataFrame:
    """``id, tie, p, anchor``: where each stretch of windows begins, and the digest that its windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column(0), batch.column(1)
            for row, place, _, _, anchor, *_ in _found(_bytes_of(batch.column(2)), size):
                at = pa.array(row)
                made = [ids.take(at), ties.take(at), pa.array(place.astype(np.int32)), pa.array(anchor.view(np.int64))]
                yield pa.RecordBatch.from_arrays(made, ["id", "tie", "p", "anchor"])

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, tie long, p int, anchor long")


def _packed(d: DataFrame) -> DataFrame:
    """``id, tie, blob``: texts compressed for a shuffle, null texts as null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            blobs = [squeeze(x.as_buffer()) if x.is_valid else None for x in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["id", "tie", "blob"])

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, tie long, blob binary")


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return (expand(x.as_buffer()) if x.is_valid else b"" for x in column)


def _stretch_rows(d: DataFrame, size: int) -> DataFrame:
    """``id, tie, p, n, anchor, key, w`` (digests of its windows) of the stretches that ``d(id, tie, blob, at)`` names by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, wanted = batch.column(0), batch.column(1), batch.column(3)
            place_of = wanted.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row_of = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy(zero_copy_only=False))
            named = np.sort(row_of << 40 | place_of)
            for row, place, first, count, anchor, key, digests in _found(_unpacked(batch.column(2)), size):
                mine = row << 40 | place
                at = np.minimum(np.searchsorted(named, mine), len(named) - 1)
                own = named[at] == mine
                if not own.any():
                    continue
                row, place, first, count, anchor, key = (x[own] for x in (row, place, first, count, anchor, key))
                ends = np.cumsum(count)
                windows = np.repeat(first - (ends - count), count) + np.arange(ends[-1])
                cuts = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                at = pa.array(row)
                made = [ids.take(at), ties.take(at), pa.array(place.astype(np.int32)), pa.array(count.astype(np.int32))]
                made += [pa.array(x.view(np.int64)) for x in (anchor, key)]
                made.append(pa.ListArray.from_arrays(cuts, pa.array(digests.of(1, windows, windows + size).view(np.int64))))
                yield pa.RecordBatch.from_arrays(made, ["id", "tie", "p", "n", "anchor", "key", "w"])

    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(run, f"id {kind}, tie long, p int, n int, anchor long, key long, w array<long>")


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & F.col(f"{a}.tie").eqNullSafe(F.col(f"{b}.tie"))


def covered(d: DataFrame, size: int = WINDOW) -> DataFrame:
    """``id, tie, spans`` of ``d(id, tie, text)``: the stretches of words, as (start, end), that windows seen before cover."""
    anchors = saved(_anchors(d, size))
    repeated = saved(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    places = saved(anchors.join(repeated, "anchor", "left_semi").groupBy("id", "tie").agg(F.collect_set("p").alias("at")))
    release(anchors, repeated)
    texts = _packed(d.where(F.octet_length("text") >= 2 * size - 1))
    named = texts.alias("t").join(places.alias("p"), _same_row("t", "p")).select("t.id", "t.tie", "t.blob", "p.at")
    rows = saved(_stretch_rows(named, size))
    release(places)

    place = F.struct("id", "tie", "p")
    contents = saved(rows.groupBy("anchor", "key").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    shared = contents.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1").select(F.col("anchor").alias("_a"))
    told = contents.join(shared, F.col("anchor") == F.col("_a"), "left")
    told = saved(told.where((F.col("n") > 1) | F.col("_a").isNotNull()).select("anchor", "key", "first", F.col("_a").isNotNull().alias("open")))
    release(contents)
    met = saved(rows.join(told, ["anchor", "key"]).select(
        "id", "tie", "p", "n", "anchor", (place > F.col("first")).alias("later"), F.when(F.col("open") & (place <= F.col("first")), F.col("w")).alias("w"),
    ).where(F.col("later") | F.col("w").isNotNull()))
    release(rows, told)

    windows = saved(met.where(F.col("w").isNotNull()).select("id", "tie", "p", "anchor", F.posexplode("w").alias("d", "w")).select(
        "id", "tie", (F.col("p") + F.col("d")).alias("p"), "anchor", "w"))
    firsts = saved(windows.groupBy("anchor", "w").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("anchor", "w", "first"))
    again = windows.join(firsts, ["anchor", "w"]).where(place > F.col("first")).select("id", "tie", "p", F.lit(1).alias("n"))
    spans = met.where("later").select("id", "tie", "p", "n").union(again)
    span = F.struct(F.col("p").alias("start"), (F.col("p") + F.col("n") + (size - 1)).alias("end"))
    out = saved(spans.groupBy("id", "tie").agg(F.array_sort(F.collect_set(span)).alias("spans")))
    release(met, windows, firsts)
    return out


def dedup_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``doc_id, text, n_words, n_removed`` per row: the words that are left, joined by single spaces, and counts.

    A word goes if a window of ``size`` consecutive words that holds it also
    starts earlier: in a document of smaller key, or before it in the same one.
    All windows are judged on the input. Null keys come first; rows of one key
    but different texts are told apart by a hash of the text, which also orders
    them, and rows that are equal in both are one document: what goes from one
    goes from the other. A null text counts no words and gives an empty text, as
    do empty ones and ones that are removed altogether. Texts of fewer words than
    a window only lose their exact spacing. Other columns are not read.
    """
    d = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = [], [], []
            for text, spans in zip(_unpacked(batch.column(1)), batch.column(2), strict=True):
                words = text.split()
                counts.append(len(words))
                if spans.is_valid:
                    keep = np.ones(len(words), bool)
                    for s in spans.as_py():
                        keep[s["start"]: s["end"]] = False
                    words = [w for w, k in zip(words, keep, strict=True) if k]
                gone.append(counts[-1] - len(words))
                texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            made = [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "text", "n_words", "n_removed"])

    joined = _packed(d).alias("t").join(covered(d, size).alias("c"), _same_row("t", "c"), "left").select("t.id", "t.blob", "c.spans")
    return joined.mapInArrow(run, f"doc_id {d.schema['id'].dataType.simpleString()}, text string, n_words long, n_removed long")


def kept_words(rows: list[tuple], size: int = WINDOW) -> list[tuple]:
    """Plain restatement for tests: ``(doc_id, n_words, n_removed, sha256 of what is kept)`` of ``(doc_id, text)`` rows with unlike ids."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = words_of(text)
        gone = set()
        for p in range(len(words) - size + 1):
            window = tuple(words[p: p + size])
            if window in seen:
                gone.update(range(p, p + size))
            seen.add(window)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def dedup_windows_sql(size: int = WINDOW, docs: str = "documents") -> str:
    """DuckDB: ``doc_id, n_words, n_removed, kept_sha256``, with every window spelled out."""
    return rf"""
    WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM {docs}),
    v AS (SELECT doc_id, p, array_to_string(ws[p : p + {size - 1}], ' ') AS win
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {size - 2})) AS p FROM t WHERE len(ws) >= {size})),
    r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS nth FROM v),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {size})) AS i FROM r WHERE nth > 1),
    w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t),
    k AS (SELECT w.doc_id, count(*) AS n_words, count(g.i) AS n_removed,
                 coalesce(string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY w.i), '') AS kept
          FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
    SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM t LEFT JOIN k ON t.doc_id = k.doc_id"""
