"""Source divergence audit against a plain restatement in Python integers."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from webframe.llm import source_audit as module
from webframe.llm.source_audit import source_audit, source_audit_sql

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def audit(rows, min_docs, top):
    """``rows``: (lang, source, text)."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        own = Counter(TERM.findall(lower(text or "")))
        n[lang, source] += own
        docs[lang].update(own.keys())
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, k in docs[lang].items() if k >= min_docs}
        sources = sorted(s for x, s in groups if x == lang)
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        share = lambda k, whole: 1 + 1_000_000_000 * (k + 5) // (whole + 5 * len(kept))  # noqa: B023, E731
        p = {s: {t: share(n[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(n[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = ["The", "of", "é", "Éa", "ÉA", "straße", "x9y", "don't", "ZZ", "中文", *[f"t{chr(97 + i)}" for i in range(20)]]
    rows = []
    for _ in range(n):
        s = rng.choice(["web", "web", "web", "book", "zine", "", None])
        words = rng.choices(vocab, weights=[1 + (hash((str(s), i)) % 7) for i in range(len(vocab))], k=rng.randint(0, 30))
        rows.append((rng.choice(["en", "en", "de", None, ""]), s, rng.choice([None, "", " ".join(words), " ".join(words)])))
    return [*rows, ("rare", "only", "one text"), ("rare", "two", ""), ("none", "x", None)]


def frame(spark, rows, extra=False):
    d = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    return d.select("*", *[F.lit(1).alias(c) for c in ("h", "part", "term", "n", "item", "value", "p", "q")]) if extra else d


@pytest.mark.parametrize("bits", [64, 3])
def test_equals_plain_counts(spark, bits):
    rows = corpus(bits)
    got = sorted(map(tuple, source_audit(frame(spark, rows, True), min_docs=8, top=5, bits=bits).collect()))
    assert got == audit(rows, 8, 5)
    assert {g[2] for g in got} == {"pair", "term"}


def test_terms_are_named_and_shared_digests_noticed():
    terms = module._Terms(3, False)
    text, which, n, digest, new, _ = terms.read([b"a B c D e f g h", b"a a A", b"1 2"])
    assert sorted({t for _, t in new}) == list("abcdefgh") and len({h for h, _ in new}) < 8
    assert n[text == 1].tolist() == [3] and 2 not in text and n.sum() == 11
    assert terms.read([b"a"])[4] in ([], [(int(digest[which[text == 1][0]]), "a")])


def test_very_long_text_is_one_document(monkeypatch, spark):
    monkeypatch.setattr(module, "PIECE", 40)
    assert b"".join(module._cut("é word ".encode() * 50)) == "é word ".encode() * 50 and len(list(module._cut(b"ab cd " * 50))) > 3


def test_empty_repeated_and_long(spark):
    assert source_audit(frame(spark, [])).count() == 0
    rows = [("en", "a", "same words here")] * 40 + [("en", "b", "word " * 60_000 + "same")] * 31
    got = sorted(map(tuple, source_audit(frame(spark, rows)).collect()))
    assert got == audit(rows, 30, 50)


def test_ties_are_cut_by_the_term(spark):
    rows = [("en", "a", "b c d e f g"), ("en", "z", "x y")] * 30
    got = sorted(map(tuple, source_audit(frame(spark, rows), top=3).collect()))
    assert got == audit(rows, 30, 3)


def test_sql_twin_equals_plain_counts():
    rows = corpus(7)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(source_audit_sql(8, 5)).fetchall()) == audit(rows, 8, 5)
