"""Near copies by Jaccard similarity of word shingles: MinHash bands give candidates, the shingle sets decide.

SimHash needs about ten of 64 bits for texts of similarity 0.8, which bands of
equal bits do not find. So each distinct text gets ``BANDS`` keys of ``ROWS``
minima; two texts of similarity s share a key with probability
``1 - (1 - s ** ROWS) ** BANDS``, 0.99997 at 0.8 and more above.

Within a key all members are first compared with the smallest one only. Members
that this leaves in different components are then compared with each other, so
every two texts that share a key end in one component or are compared. In keys
with more than ``CROWD`` members most of that is settled by counting, see
``_crowd_links``: copies that differ in shingles of their own take linear work,
whether they link or not.

The links of :mod:`webframe.llm.simhash` (two bits, three words) can be added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.llm import simhash
from webframe.llm.common import saved
from webframe.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS, SEED = 20, 4, 42
#: Shingles whose hashes are permuted at a time.
BLOCK = 4096
#: Members of a key up to which those in different components all meet.
CROWD = 32
#: Texts of crowded keys up to which a shingle is rare: those that share one are compared.
RARE = 8
#: Longs that a text's common shingles are folded to; a power of two.
WORDS = 4

_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64)[:, None]
_TIMES = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64)[:, None] | np.uint64(1)
_MIX = _rng.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 2**64, BANDS, np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; a shorter text is one shingle, a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    last = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.array([digest(b" ".join(words[i: i + shingle]), SEED) for i in range(last)], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band, as signed longs; the number of the band is part of its key."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        mixed = (hashes[at: at + BLOCK] ^ _FLIP) * _TIMES
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=1))
    return ((least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def _banded(docs: DataFrame, shingle: int, fingerprints: bool) -> DataFrame:
    """``doc_id, code, n, keys, fp`` (null unless asked for) per row of ``docs(doc_id, code, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), shingle) for t in batch.column(2)]
            n = pa.array([len(s) for s in sets], pa.int32())
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            prints = [simhash.fingerprint(t.as_py()) for t in batch.column(2)] if fingerprints else []
            fp = pa.array(np.array(prints, np.uint64).view(np.int64)) if fingerprints else pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, keys, fp], ["doc_id", "code", "n", "keys", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, code long, n int, keys array<long>, fp long")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``code, items`` per row of ``texts(code, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([shingles(t.as_py(), shingle).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), items], ["code", "items"])

    return texts.mapInArrow(run, "code long, items array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are that similar; two empty sets are equal."""
    p = pairs.join(sets.select(F.col("code").alias("a"), F.col("items").alias("x")), "a")
    p = p.join(sets.select(F.col("code").alias("b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return p.where(both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def _near_size(n: Column, m: Column, similarity: float) -> Column:
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def _folded(items: str) -> Column:
    """``WORDS`` longs in which every item of the array flips one bit; two sets differ in at least as many items as these differ in bits."""
    place = lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(WORDS - 1))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    one = lambda i: F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.when(place(x) == i, bit(x)).otherwise(F.lit(0).cast("long"))))
    return F.array(*[one(i) for i in range(WORDS)])


def _may_match(a: str, b: str, need: float) -> Column:
    """Whether the structs of two texts allow *need* of their sizes to be shared in common shingles."""
    both = need * (F.col(f"{a}.n") + F.col(f"{b}.n"))
    apart = sum((F.bit_count(F.get(f"{a}.bits", F.lit(i)).bitwiseXOR(F.get(f"{b}.bits", F.lit(i)))) for i in range(WORDS)), F.lit(0))
    return (F.least(f"{a}.c", f"{b}.c") >= both - 1e-9) & (apart <= F.col(f"{a}.c") + F.col(f"{b}.c") - 2 * both + 1e-9)


def _crowd_links(members: DataFrame, sets: DataFrame, similarity: float, rare: int = RARE) -> DataFrame:
    """Alike ``(a, b)`` of ``members(key, code, n, root)``, so that any two of a key that are alike get connected.

    Two texts that share a rare shingle (one of at most *rare* texts) are compared.
    Others share common shingles only. Texts with the same common shingles are a
    class, and its smallest text is like every text that any of the class is
    like: so members need to meet only the smallest of a class, and a member
    linked to the smallest of its own need not meet at all. Of two alike texts
    without a rare shingle in common the smaller one has at most a ninth of rare
    shingles (at similarity 0.8); a text with that few is linked to the smallest
    of its class. So only smallest texts with few rare shingles meet the others.

    First the members of a key meet its hub, the text with the fewest rare
    shingles for its size. What that leaves apart meets by count and by folded
    bits of the common shingles: pairs that these rule out are not compared, and
    two texts of a key's largest component do not meet.
    """
    need = similarity / (1 + similarity)  # of both sizes together must be shared
    nodes = saved(members.select("code", "n", "root").distinct())
    s = saved(sets.join(nodes, "code"))
    # the few files of s would be few tasks
    dealt = s.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    items = dealt.select("code", "n", "root", F.explode("items").alias("item"))
    few = items.groupBy("item").agg(F.count("*").alias("texts")).where(F.col("texts") <= rare)
    held = saved(items.join(few, "item"))
    here = held.where("texts > 1").groupBy("item").agg(F.collect_list(F.struct("code", "n", "root")).alias("here"))
    both = here.select(F.explode("here").alias("p"), "here").select("p", F.explode("here").alias("o"))
    differ = (F.col("p.code") < F.col("o.code")) & (F.col("p.root") != F.col("o.root"))
    sharing = both.where(differ & _near_size(F.col("p.n"), F.col("o.n"), similarity)).select(F.col("p.code").alias("a"), F.col("o.code").alias("b"))

    own = held.groupBy("code").agg(F.collect_list("item").alias("own"))
    common = F.array_except("items", F.coalesce("own", F.array().cast("array<bigint>")))
    split = s.join(own, "code", "left").select("code", "n", "root", common.alias("common"))
    split = saved(split.select("code", "n", "root", F.size("common").alias("c"), F.xxhash64("common").alias("class"), _folded("common").alias("bits")))
    least = split.groupBy("class").agg(F.min(F.struct("n", "code", "root")).alias("least"))
    stars = split.join(least, "class").where(F.col("root") != F.col("least.root")).select(F.col("least.code").alias("a"), F.col("code").alias("b"))
    m = saved(members.select("key", "code").join(split, "code"))
    text = F.struct("n", "code", "root", "c", "bits")
    hubs = m.groupBy("key").agg(F.max_by(text, F.struct(F.col("c") - need * F.col("n"), "code")).alias("hub"))
    hubs = m.select("key", text.alias("o")).join(hubs, "key").where((F.col("o.root") != F.col("hub.root")) & _may_match("hub", "o", need))
    hubs = hubs.select(F.col("hub.code").alias("a"), F.col("o.code").alias("b"))
    pairs = sharing.union(stars).union(hubs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = saved(_alike(saved(pairs.distinct()), sets, similarity))

    named = nodes.select("code", "root")
    ends = links.join(named.toDF("a", "ra"), "a").join(named.toDF("b", "rb"), "b")
    now = saved(components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))).toDF("root", "now")
    m = m.join(now, "root", "left").withColumn("root", F.coalesce("now", "root")).drop("now")
    main = m.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key")
    main = main.agg(F.count("*").alias("roots"), F.max_by("root", F.struct("size", "root")).alias("main")).where("roots > 1").drop("roots")
    m = saved(m.join(main, "key").withColumn("inside", F.col("root") == F.col("main")).drop("main"))
    least = saved(m.groupBy("key", "class").agg(F.min(F.struct("n", "code", "root", "c", "bits", "inside")).alias("least")))
    linked = (F.col("c") >= need * (F.col("n") + F.col("least.n")) - 1e-9) | (F.col("root") == F.col("least.root"))
    o = F.struct("n", "code", "root", "c", "bits", "inside").alias("o")
    loose = m.join(least, ["key", "class"]).where((F.col("code") != F.col("least.code")) & ~linked).select("key", o)
    heads = least.select("key", F.col("least").alias("o"))
    small = heads.where(F.col("o.c") >= 2 * need * F.col("o.n") - 1e-9).withColumnRenamed("o", "p")
    # texts inside meet those outside, texts outside meet all
    small = small.select("key", "p", F.explode(F.when(F.col("p.inside"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("inside"))
    others = heads.union(loose).select("key", F.col("o.inside").alias("inside"), "o")
    meet = small.join(others, ["key", "inside"]).where((F.col("p.root") != F.col("o.root")) & (F.col("p.n") <= F.col("o.n")) & _may_match("p", "o", need))
    meet = meet.select(F.least("p.code", "o.code").alias("a"), F.greatest("p.code", "o.code").alias("b"))
    return links.union(_alike(saved(meet.distinct()), sets, similarity))


def _print_links(codes: DataFrame) -> DataFrame:
    """``(a, b)`` of ``codes(code, fp)``: texts with one fingerprint, and with fingerprints that SimHash links."""
    named = saved(codes.groupBy("fp").agg(F.min("code").alias("named")))
    same = codes.join(named, "fp").where("code <> named").select(F.col("named").alias("a"), F.col("code").alias("b"))
    near = simhash.near_links(named.select("fp"))
    near = near.join(named.select(F.col("fp").alias("a"), F.col("named").alias("na")), "a")
    near = near.join(named.select(F.col("fp").alias("b"), F.col("named").alias("nb")), "b")
    return same.union(near.select("na", "nb"))


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, fingerprints: bool = False, crowd: int = CROWD
) -> DataFrame:
    """``doc_id, component_id`` per row of *docs*.

    Documents link if the Jaccard similarity of their lower-cased word shingles
    reaches *similarity*, and with *fingerprints* also if SimHash links them;
    ``component_id`` is the smallest doc_id that can be reached. Null and empty texts have no shingles and link with each other.
    Repeated rows give a row each; a null doc_id gets a component but names none
    (a component of nulls only is null). Only key and text are read. Keys with
    more than *crowd* members take the way for large groups.
    """
    d = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("code"), F.col(text).alias("text"))
    rows = saved(_banded(d, shingle, fingerprints))
    codes = saved(rows.groupBy("code").agg(F.min("doc_id").alias("smallest"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp")))
    keyed = codes.select("code", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("code", "n")).alias("first")).where("members > 1")
    keyed = saved(keyed.join(saved(shared), "key").select("key", "code", "n", "first"))
    wanted = saved(keyed.select("code").distinct())
    sets = saved(_sets(d.select("code", "text").join(wanted, "code", "left_semi").groupBy("code").agg(F.first("text").alias("text")), shingle))

    stars = keyed.where((F.col("code") != F.col("first.code")) & _near_size(F.col("n"), F.col("first.n"), similarity))
    links = _alike(stars.select(F.col("first.code").alias("a"), F.col("code").alias("b")).distinct(), sets, similarity)
    links = saved(links.union(_print_links(codes.select("code", "fp"))) if fingerprints else links)
    rooted = saved(components(links))
    # keys whose members are not one component yet: the members outside the key's largest component meet all others
    named = keyed.where(F.col("code") != F.col("first.code")).join(rooted, F.col("code") == F.col("node"), "left")
    named = saved(named.select("key", "code", "n", F.coalesce("root", "code").alias("root")))
    parts = named.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key")
    parts = parts.agg(F.count("*").alias("roots"), F.sum("size").alias("size"), F.max_by("root", F.struct("size", "root")).alias("main"))
    open_keys = saved(parts.where("roots > 1").select("key", "main", "size"))
    members = named.join(open_keys.where(F.col("size") <= crowd).drop("size"), "key")
    outside = members.where(F.col("root") != F.col("main")).select("key", F.col("code").alias("o"), F.col("n").alias("m"), F.col("root").alias("other"))
    meet = outside.join(members, "key").where((F.col("root") != F.col("other")) & _near_size(F.col("n"), F.col("m"), similarity))
    meet = meet.select(F.least("code", "o").alias("a"), F.greatest("code", "o").alias("b"))
    links = links.union(_alike(saved(meet.distinct()), sets, similarity))
    crowded = saved(named.join(open_keys.where(F.col("size") > crowd).select("key"), "key"))
    if not crowded.isEmpty():
        links = links.union(_crowd_links(crowded, sets, similarity))

    rooted = saved(components(links))
    by_code = codes.join(rooted, codes["code"] == rooted["node"], "left").select("code", F.coalesce("root", "code").alias("root"), "smallest")
    least = by_code.groupBy("root").agg(F.min("smallest").alias("component_id"))
    final = saved(by_code.join(least, "root").select("code", "component_id"))
    return rows.select("doc_id", "code").join(final, "code").select("doc_id", "component_id")
