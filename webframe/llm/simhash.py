"""Near-duplicates by SimHash fingerprints, with pivot distance tables.

* ``fingerprints``: 64-bit SimHash over three-word shingles, one pass.
* ``pivot_table``: for each distinct fingerprint its Hamming distances to many
  fixed reference fingerprints (pivots). By the triangle inequality two
  fingerprints that differ in at most ``RADIUS`` bits differ by at most that in
  every one of these coordinates, so a pair is discarded as soon as its largest
  coordinate difference is greater; only survivors are compared bit by bit.
* Pivots alone leave too many pairs to try: coordinates of unrelated texts
  crowd round 32. So pairs are only formed where two of four 16-bit bands are
  equal, which holds for every pair within two bits. Each pair of bands is one
  equi-join key, and the pivot table decides within it.
* A key that many distinct fingerprints share (a large group of near copies) is
  not paired at all. Its members send themselves to the 65 codes within one
  bit. Two fingerprints within two bits meet at such a code, and all that meet
  there are within two bits of each other, so linking each to the smallest one
  there gives the same components with 65 rows per fingerprint, whatever the
  size of the group.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.llm.common import saved
from webframe.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
BITS = 64
PIVOTS = 16
BANDS = 4
#: Distinct fingerprints that share a key up to which pairs are formed; beyond it the one-bit codes are used.
CROWD = 32

_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1:].tolist(), strict=True)]
    rows = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(rows[:, j], minlength=256) @ _BIT_OF_BYTE for j in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)`` per row; the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes)], ["doc_id", "fp"])

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def _hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivots(n: int = PIVOTS) -> list[int]:
    """Fixed pseudo-random reference fingerprints, as signed longs."""
    rng = random.Random(BITS)
    return [rng.getrandbits(BITS) - (1 << (BITS - 1)) for _ in range(n)]


def pivot_table(codes: DataFrame) -> DataFrame:
    """``codes(fp)`` with ``dist``: its distances to all pivots."""
    return codes.withColumn("dist", F.array(*[_hamming(F.col("fp"), F.lit(p)).cast("tinyint") for p in pivots()]))


def _keys(fp: Column) -> Column:
    width = BITS // BANDS
    band = [F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BANDS)]
    kept = combinations(range(BANDS), BANDS - RADIUS)
    return F.array(*[
        F.struct(F.lit(k).cast("tinyint").alias("slot"), reduce(lambda a, b: a * F.lit(1 << width) + b, [band[i] for i in which]).alias("value"))
        for k, which in enumerate(kept)
    ])


def near_links(codes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``(a, b)`` of distinct fingerprints: links that give the same components as all pairs within ``RADIUS`` bits.

    Keys with up to ``crowd`` members give all their pairs within the radius, by
    pivot table; of the members of fuller keys the links to the smallest at each
    one-bit code are given.
    """
    table = pivot_table(codes.select("fp").distinct())
    keyed = saved(table.select("fp", "dist", F.explode(_keys(F.col("fp"))).alias("key")))
    shared = saved(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    few = keyed.join(shared.where(F.col("members") <= crowd).select("key"), "key")
    other = few.select("key", F.col("fp").alias("b"), F.col("dist").alias("other"))
    apart = reduce(F.greatest, [F.abs(F.get("dist", F.lit(i)) - F.get("other", F.lit(i))) for i in range(PIVOTS)])
    close = (F.col("fp") < F.col("b")) & (apart <= RADIUS) & (_hamming(F.col("fp"), F.col("b")) <= RADIUS)
    pairs = few.join(other, "key").where(close).select(F.col("fp").alias("a"), "b")
    crowded = keyed.join(shared.where(F.col("members") > crowd).select("key"), "key").select("fp").distinct()
    flips = [F.lit(0).cast("long"), *[F.lit((1 << i) - ((1 << BITS) if i == BITS - 1 else 0)) for i in range(BITS)]]
    at = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(f) for f in flips])).alias("code"))
    # at most 65 fingerprints lie within one bit of a code, so this list is short by nature
    meets = at.groupBy("code").agg(F.collect_set("fp").alias("here")).where(F.size("here") > 1)
    stars = meets.select(F.array_min("here").alias("a"), F.explode("here").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """``doc_id, fingerprint (hex), component_id`` per row of *docs*.

    Documents link if their fingerprints differ in at most two bits;
    ``component_id`` is the smallest doc_id that can be reached. Null and empty
    texts have fingerprint zero and link like any other. Repeated rows give a
    row each; a null doc_id gets a component but names none (a component of
    nulls only is null). Only key and text are read. Exact copies share a
    fingerprint and are one node of the graph.
    """
    prints = saved(fingerprints(docs, key, text))
    codes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    rooted = saved(components(near_links(codes, crowd)))
    by_code = codes.join(rooted, codes["fp"] == rooted["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "smallest")
    named = by_code.groupBy("root").agg(F.min("smallest").alias("component_id"))
    final = saved(by_code.join(named, "root").select("fp", "component_id"))
    return prints.join(final, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
