"""Source divergence audit: term shares of every source against the other sources and the language, in exact integers.

Terms cross shuffles as 64-bit digests; their strings come late:

* One pass over the texts counts, per task, the digests of every (language, source),
  and writes each term once beside its digest.
* A dictionary of digests keeps the smallest and the largest string of each. Where
  the two differ, several terms share a digest; only for these are the texts read
  again, and the string is taken into their key. All other keys stay of fixed width.
* Everything after that is done on digests: document frequencies, kept terms, totals,
  shares, pairs of sources. Strings are joined back for the rows of the report only.

Pairs of sources are not compared term by term over the whole vocabulary. A term that
a source lacks has that source's smallest share, so the sum over all kept terms
follows from each source's own terms, counted by how often they occur, and a
correction for the terms that both have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webframe.llm.common import saved
from webframe.llm.recompression import PIECE, word_digests
from webframe.plans.lineage import release
from webframe.plans.ordering import top_per_key

MIN_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
SMOOTH = 5
#: Counts, and terms already named, that a task holds.
MAX_ROWS, MAX_NAMED = 1_000_000, 200_000
EXACT = "decimal(38,0)"

_BYTE = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, and the bytes that terms are made of: ASCII letters and all of what lies beyond ASCII.
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_TERM = ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_COUNTED = "lang string, source string, h long, n long, docs long, term string"


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PIECE`` bytes."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= PIECE:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _cut(text: bytes) -> Iterator[bytes]:
    """A very long text in pieces that end where no term is."""
    at = 0
    while len(text) - at > 2 * PIECE:
        end = at + PIECE
        while end < len(text) and _TERM[_LOWER[text[end]]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


class _Terms:
    """Digests of the terms of some texts, and the spelling of those not named before."""

    def __init__(self, bits: int, spelled_out: bool):
        self.shift, self.spelled_out = 64 - bits, spelled_out
        self.named: dict[int, int] = {}

    def read(self, texts: list[bytes]):
        """For each (text, term): text, place of the term's digest, number; the digests; ``(digest, term)`` of the terms that are new.

        Spelled out, terms are told apart by both lanes, and the spelling of every digest comes last.
        """
        data = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        begins = np.cumsum([0, *map(len, texts)])[:-1]
        start, end, text, lanes = word_digests(data, begins, _TERM)
        digest = (lanes[0] >> np.uint64(self.shift)).view(np.int64)
        if not len(start):
            return text, text, text, digest, [], []
        if self.spelled_out:
            digest_of, first, of = np.unique(np.stack([lanes[0], lanes[1]], 1), axis=0, return_index=True, return_inverse=True)
            of = of.ravel()
        else:
            digest_of, first, of = np.unique(digest, return_index=True, return_inverse=True)
        spell = lambda k: data[start[k]: end[k]].tobytes().decode("utf-8", "replace")
        pairs, number = np.unique(text * len(first) + of, return_counts=True)
        which = pairs % len(first)
        if self.spelled_out:
            return pairs // len(first), which, number, digest[first], [], [spell(k) for k in first]
        new = []
        second = lanes[1][first]
        for k, h, other in zip(first.tolist(), digest_of.tolist(), second.tolist(), strict=True):
            if self.named.get(h) != other:
                if len(self.named) >= MAX_NAMED:
                    self.named.clear()
                self.named[h] = other
                new.append((h, spell(k)))
        for k in np.flatnonzero(lanes[1] != second[of]):  # a digest that several terms share
            new.append((int(digest[k]), spell(k)))
        return pairs // len(first), which, number, digest_of, new, []


def _summed(*columns: np.ndarray) -> list[np.ndarray]:
    """Rows of ``(group, digest, n, docs)`` with equal group and digest added up."""
    group, digest, n, docs = columns
    order = np.lexsort((digest, group))
    group, digest, n, docs = (c[order] for c in columns)
    first = np.ones(len(group), bool)
    first[1:] = (group[1:] != group[:-1]) | (digest[1:] != digest[:-1])
    at = np.flatnonzero(first)
    return [group[at], digest[at], np.add.reduceat(n, at), np.add.reduceat(docs, at)] if len(at) else [group, digest, n, docs]


def _grouped(group: np.ndarray, which: np.ndarray, n: np.ndarray, digest: np.ndarray) -> list[np.ndarray]:
    """The same for one row per text and term, of few groups and terms; ``which`` is the place of the digest."""
    size = max(1, len(digest))
    key, at = np.unique(group * size + which, return_inverse=True)
    return [key // size, digest[key % size], np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))]


def _counted(d: DataFrame, bits: int) -> DataFrame:
    """Partial counts of ``d(lang, source, text)`` by digest (``term`` null), and the terms of the digests (``lang`` null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(bits, False)
        groups: dict[tuple[str, str], int] = {}
        held: list[list[np.ndarray]] = []

        def counts() -> pa.RecordBatch:
            group, h, n, docs = held[0]
            names = [pa.array([g[k] for g in groups], pa.string()).take(pa.array(group)) for k in (0, 1)]
            made = [*names, *(pa.array(x.astype(np.int64)) for x in (h, n, docs)), pa.nulls(len(h), pa.string())]
            held.clear()
            return pa.RecordBatch.from_arrays(made, ["lang", "source", "h", "n", "docs", "term"])

        def spelled(new: list[tuple[int, str]]) -> pa.RecordBatch:
            k = len(new)
            made = [pa.nulls(k, pa.string()), pa.nulls(k, pa.string()), pa.array([h for h, _ in new], pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())]
            return pa.RecordBatch.from_arrays([*made, pa.array([t for _, t in new], pa.string())], ["lang", "source", "h", "n", "docs", "term"])

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            group_of = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, sources, strict=True)], np.int64)
            texts = [x.as_buffer().to_pybytes() for x in batch.column(2).cast(pa.binary())]
            for lo, hi in _blocks(texts):
                found = []
                if hi - lo == 1:  # one text may be very long: its pieces are one document
                    for piece in _cut(texts[lo]):
                        _, which, n, h, new, _ = terms.read([piece])
                        found.append([np.zeros(len(n), np.int64), h[which], n, np.ones(len(n), np.int64)])
                        if new:
                            yield spelled(new)
                    _, h, n, _ = _summed(*map(np.concatenate, zip(*found, strict=True)))
                    rows = [np.full(len(h), group_of[lo]), h, n, np.ones(len(h), np.int64)]
                else:
                    text, which, n, h, new, _ = terms.read(texts[lo:hi])
                    if new:
                        yield spelled(new)
                    rows = _grouped(group_of[lo + text], which, n, h)
                held.append(rows)
                if sum(len(x[0]) for x in held) >= MAX_ROWS:
                    held[:] = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) >= MAX_ROWS // 2:
                        yield counts()
        if held:
            held[:] = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
            yield counts()

    return d.mapInArrow(run, _COUNTED)


def _spelled_counts(d: DataFrame, bits: int) -> DataFrame:
    """The same counts with every term spelled out, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(bits, True)
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() for x in batch.column(2).cast(pa.binary())]
            for lo, hi in _blocks(texts):
                text, which, n, h, _, names = terms.read(texts[lo:hi])
                at = pa.array(lo + text)
                made = [batch.column(0).take(at), batch.column(1).take(at), pa.array(h[which]), pa.array(n.astype(np.int64)), pa.array(np.ones(len(n), np.int64))]
                made.append(pa.array(names, pa.string()).take(pa.array(which)))
                yield pa.RecordBatch.from_arrays(made, ["lang", "source", "h", "n", "docs", "term"])

    return d.mapInArrow(run, _COUNTED)


def _summed_up(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _by_source(d: DataFrame, counted: DataFrame, min_docs: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts by (lang, source, h, part), the kept terms by (lang, h, part), and ``h, term`` of the digests of one term.

    ``part`` is null but for the terms of shared digests. A digest that reaches too few
    documents as a whole has no kept term, so only the others are spelled and split.
    """
    none = F.lit(None).cast("string").alias("part")
    whole = saved(_summed_up(counted.where(F.col("term").isNull()), "lang", "source", "h"))
    reach = saved(_summed_up(whole, "lang", "h").where(F.col("docs") >= min_docs))
    named = counted.where(F.col("term").isNotNull()).select("h", "term").join(reach.select("h").distinct(), "h", "left_semi")
    spelled = named.groupBy("h").agg(F.min("term").alias("term"), F.max("term").alias("most"))
    spelled = saved(spelled)
    shared = saved(spelled.where(F.col("most") > F.col("term")).select("h"))
    alone = spelled.where(F.col("most") == F.col("term")).select("h", "term")
    if not shared.limit(1).count():
        return whole.select("lang", "source", "h", none, "n"), reach.select("lang", "h", none, "n"), alone
    # texts are read again for the terms of shared digests only
    again = _spelled_counts(d, bits).join(shared, "h", "left_semi").select("lang", "source", "h", F.col("term").alias("part"), "n", "docs")
    parts = whole.join(shared, "h", "left_anti").select("lang", "source", "h", none, "n", "docs")
    parts = saved(parts.unionByName(_summed_up(again, "lang", "source", "h", "part")))
    kept = _summed_up(parts, "lang", "h", "part").where(F.col("docs") >= min_docs)
    return parts.drop("docs"), saved(kept.drop("docs")), alone


def _share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms))``, with 38 digits."""
    part, whole = (F.lit(SCALE).cast(EXACT) * (n + SMOOTH).cast("decimal(19,0)")).cast(EXACT), (total + SMOOTH * terms).cast(EXACT)
    return (F.lit(1).cast("long") + F.call_function("div", part, whole)).cast("long")


def _same(left: str, right: str, *names: str) -> Column:
    """Equal names; only ``part`` can be null."""
    tests = [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) if n == "part" else F.col(f"{left}.{n}") == F.col(f"{right}.{n}") for n in names]
    return reduce(Column.__and__, tests)


def source_audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source", bits: int = 64
) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (language, source) that occurs.

    ``pair`` rows name each other source of the language, with the sum over the kept
    terms of how far the two shares lie apart, all ranks. ``term`` rows name the kept
    terms that the source has and that have a larger share there than in the language,
    with the difference, ``top`` ranks. Larger values come first, ties in order of the
    item's UTF-8. Null texts, languages and sources are read as empty; empty texts and
    languages without kept terms take part (their pairs have value 0). Repeated rows
    count as often as they occur. Only the three named columns are read.
    """
    d = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = saved(_counted(d, bits))
    groups = saved(d.select("lang", "source").distinct())
    by_source, kept, alone = _by_source(d, counted, min_docs, bits)
    langs = saved(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("total")))

    own = by_source.alias("s").join(kept.alias("k"), _same("s", "k", "lang", "h", "part"))
    own = own.select("s.lang", "s.source", "s.h", "s.part", "s.n", F.col("k.n").alias("lang_n"))
    totals = groups.alias("g").join(own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_own")).alias("o"), _same("g", "o", "lang", "source"), "left")
    totals = totals.join(langs.alias("l"), F.col("g.lang") == F.col("l.lang"), "left").select(
        "g.lang", "g.source", F.coalesce("o.total", F.lit(0)).alias("total"), F.coalesce("o.n_own", F.lit(0)).alias("n_own"),
        F.coalesce("l.terms", F.lit(0)).alias("terms"), F.coalesce("l.total", F.lit(0)).alias("lang_total"),
    )
    totals = saved(totals.withColumn("least", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms")))))
    shares = own.alias("o").join(totals.alias("t"), _same("o", "t", "lang", "source")).select(
        "o.lang", "o.source", "o.h", "o.part", "o.n", "t.least",
        _share(F.col("o.n"), F.col("t.total"), F.col("t.terms")).alias("p"),
        _share(F.col("o.lang_n"), F.col("t.lang_total"), F.col("t.terms")).alias("q"),
    )
    shares = saved(shares)
    pairs, terms = _pairs(totals, shares), _terms(shares, alone, top)
    out = saved(pairs.unionByName(terms))
    release(counted, langs, shares)
    return out


def _pairs(totals: DataFrame, shares: DataFrame) -> DataFrame:
    """Sums over all kept terms of ``|p - q|``, for every two sources of a language."""
    a, b = totals.alias("a"), totals.alias("b")
    both = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source"))).select(
        F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.col("a.least").alias("least"),
        F.col("b.least").alias("other"), F.col("a.n_own").alias("n_own"), F.col("b.n_own").alias("n_other"), F.col("a.terms").alias("terms"),
    )
    both = saved(both)
    # each source's own terms against the smallest share of the other: one row per distinct share
    spread = saved(shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m")))
    sided = both.select("lang", "source", "item", "other").alias("b").join(spread.alias("s"), _same("b", "s", "lang", "source"))
    sided = sided.groupBy("b.lang", "b.source", "b.item").agg(F.sum(F.col("s.m") * F.abs(F.col("s.p") - F.col("b.other"))).alias("sided"))
    # terms that both sources have, each pair once
    x, y = shares.alias("x"), shares.alias("y")
    met = x.join(y, _same("x", "y", "lang", "h", "part") & (F.col("x.source") < F.col("y.source"))).groupBy(
        F.col("x.lang").alias("lang"), F.col("x.source").alias("one"), F.col("y.source").alias("two")
    ).agg(
        F.count("*").alias("shared"),
        F.sum(F.abs(F.col("x.p") - F.col("y.p")) - F.abs(F.col("x.p") - F.col("y.least")) - F.abs(F.col("y.p") - F.col("x.least"))).alias("change"),
    )
    met = saved(met)
    met = met.select("lang", F.col("one").alias("source"), F.col("two").alias("item"), "shared", "change").union(
        met.select("lang", "two", "one", "shared", "change"))
    sided = saved(sided.select("lang", "source", "item", "sided"))
    back = sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("sided").alias("back"))
    d = both
    for side in (sided, back, met):
        d = d.alias("d").join(side.alias("e"), _same("d", "e", "lang", "source", "item"), "left").select(
            "d.*", *[F.col(f"e.{c}") for c in side.columns if c not in ("lang", "source", "item")])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    bare = F.col("terms") - F.col("n_own") - F.col("n_other") + zero("shared")
    value = zero("sided") + zero("back") + zero("change") + bare * F.abs(F.col("least") - F.col("other"))
    d = d.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("terms") > 0, value).otherwise(0).cast("long").alias("value"))
    # (language, source) pairs are the report itself: a group has as many rows as the language has sources
    return _ranked(d, None)


def _terms(shares: DataFrame, alone: DataFrame, top: int) -> DataFrame:
    """The terms that stand out most; ties at the last rank are kept until the strings decide."""
    found = shares.where(F.col("p") > F.col("q")).select("lang", "source", "h", "part", (F.col("p") - F.col("q")).alias("value"))
    place = F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))
    found = saved(found.withColumn("place", place).where(F.col("place") <= top).drop("place"))
    wanted = found.where(F.col("part").isNull()).select("h").distinct()
    spelled = saved(alone.join(wanted, "h", "left_semi").select("h", "term"))
    named = found.alias("f").join(spelled.alias("w"), (F.col("f.h") == F.col("w.h")) & F.col("f.part").isNull(), "left")
    named = named.select("f.lang", "f.source", F.lit("term").alias("part"), F.coalesce("f.part", "w.term").alias("item"), "f.value")
    return _ranked(named, top)


def _ranked(d: DataFrame, top: int | None) -> DataFrame:
    order = [F.desc("value"), F.asc("item")]
    if top is not None:
        return top_per_key(d, ["lang", "source"], order, top, "rank").select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    return d.select("lang", "source", "part", "item", "value", rank.cast("int").alias("rank"))


def source_audit_sql(min_docs: int = MIN_DOCS, top: int = TOP, docs: str = "documents") -> str:
    """DuckDB: the same report, every kept term against every pair of sources."""
    share = lambda n, total: f"1 + ({SCALE}::HUGEINT * ({n} + {SMOOTH})) // ({total} + {SMOOTH} * terms)"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM {docs}),
    o AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
    kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= {min_docs}),
    langs AS (SELECT lang, count(*)::HUGEINT AS terms, sum(n)::HUGEINT AS total FROM kept GROUP BY 1),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM o JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
    t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY 1, 2),
    p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "t.total")} AS p, {share("k.n", "l.total")} AS q
          FROM t JOIN kept k ON t.lang = k.lang JOIN langs l ON l.lang = t.lang
          LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                     coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
                               WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
    rows AS (SELECT * FROM pairs UNION ALL
             SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows)
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
