"""Decontamination, line dedup and SimHash against brute force."""

import random
import re

import pytest
import xxhash

from webframe.llm import decontaminate, line_dedup, simhash
from webframe.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def leaks(docs, items, size=10):
    wins = set()
    for i, t in items:
        w = WORD.findall(lower(t))
        wins |= {(i, tuple(w[s:s + size])) for s in range(max(1, len(w) - size + 1))} if w else set()
    out = []
    for d, t in docs:
        w, hit, named = WORD.findall(lower(t)), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    named.add(i)
        names = sorted(str(i) for i in named if i is not None)
        out.append((d, len(w), len(hit), len(names), names, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontaminate_both_ways(spark, docs, messy, limit):
    rng = random.Random(limit)
    vocab = ["the", "of", "rare1", "rare2", "Éa", "x9", "and", "is"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 9, 10, 12, 25])))) for i in range(12)]
    items += [(12, None), (13, "..."), (None, "only a null item has this"), (0, items[0][1]), (14, items[1][1]), (15, "never seen anywhere")]
    rows = [(100 + i, ", ".join(rng.choices(vocab, k=200))) for i in range(20)]
    rows += [(200 + i, f"Before {rng.choice(items)[1]} after. {t}") for i, (_, t) in enumerate(items)]
    short = [(i, t) for i, t in messy if i not in (10, 6)] + [(300, "of " * 1500)]
    got = decontaminate.decontaminate(docs(rows + short, clash=True), spark.createDataFrame(items, "item_id bigint, text string"), broadcast_bytes=limit)
    assert sorted(map(tuple, got.collect()), key=str) == leaks(rows + short, items)


def test_decontaminate_repeats_and_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    got = decontaminate.decontaminate(docs([(1, "x a b c"), (1, "x a b c"), (2, None)]), items).collect()
    assert sorted(r.n_hit for r in got) == [0, 3, 3]
    assert decontaminate.decontaminate(docs([]), items).count() == 0
    assert [r.contaminated for r in decontaminate.decontaminate(docs([(1, "a b c")]), items.limit(0)).collect()] == [False]


def repeated(rows):
    """Cleaned text, lines and removed lines per row; rows in order of id."""
    seen, gone = {}, {}
    lines = [(d, (t or "").split("\n")) for d, t in rows]
    for d, ls in sorted(lines, key=lambda x: (x[0] is not None, x[0])):
        full = [i for i, x in enumerate(ls) if x.strip(" \t\r\x0b\x0c")]
        for k in range(len(full) - 2):
            at = full[k:k + 3]
            first = seen.setdefault(tuple(ls[i].strip(" \t\r\x0b\x0c") for i in at), (d, k))
            if first != (d, k):
                gone.setdefault(d, set()).update(at)
    return sorted(
        ((d, None if t is None else "\n".join(x for i, x in enumerate(ls) if i not in gone.get(d, ())),
          0 if t is None else len(ls), 0 if t is None else len([i for i in gone.get(d, ()) if i < len(ls)])) for (d, t), (_, ls) in zip(rows, lines, strict=True)),
        key=str,
    )


def test_line_dedup(docs, messy):
    rng = random.Random(3)
    passage = [f"passage line {i}" for i in range(6)]
    rows = []
    for d in range(20, 60):
        own = [rng.choice(["a", "b", "", "  ", "c \r", f"own {d}"]) for _ in range(rng.randint(0, 12))]
        at = rng.randint(0, len(own))
        rows.append((d, "\n".join(own[:at] + (passage if d % 2 else passage[1:4]) + own[at:])))
    rows += [(i, t) for i, t in messy if i not in (None, 10)]
    got = line_dedup.dedup_lines(docs(rows, clash=True))
    own = [c for c in got.columns if c not in ("doc_id", "text", "n_lines", "n_removed")]
    assert "covered" in own and all(got.first()[c] == f"own {c}" for c in own)
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str) == repeated(rows)
    assert any(r[3] for r in repeated(rows))


def test_line_dedup_keeps_a_copy_of_every_line(docs):
    rows = [(i, "\n".join(["p", "q", "r", "s"] * 5 + [f"own {i}"])) for i in range(5)] + [(None, "p\nq\nr"), (None, None)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect() if r.doc_id is not None}
    assert set("\n".join(got.values()).split("\n")) <= {"p", "q", "r", "s", *(f"own {i}" for i in range(5))}
    assert all(f"own {i}" in got[i] for i in range(5))
    assert line_dedup.dedup_lines(docs([])).count() == 0


def fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(codes):
    left, out = set(codes), {}
    while left:
        group = todo = {left.pop()}
        while todo:
            todo = {b for a in todo for b in left if (a ^ b).bit_count() <= 2}
            left -= todo
            group = group | todo
        out |= dict.fromkeys(group, min(group))
    return out


@pytest.mark.parametrize("crowd", [1, 3, 1000])
def test_links_of_clusters(spark, crowd):
    rng = random.Random(crowd)
    codes = set()
    for size in (1, 2, 5, 60):
        center = rng.getrandbits(64)
        codes |= {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)) for _ in range(size)}
        codes |= {center, center ^ 3, center ^ 15, center ^ (1 << 63), center ^ (3 << 62) ^ 1}
    signed = {c - (1 << 64) if c >> 63 else c for c in codes}
    links = simhash.near_links(spark.createDataFrame([(c,) for c in signed], "fp long"), crowd)
    pairs = [tuple(r) for r in links.collect()]
    mask = (1 << 64) - 1
    assert all(((a & mask) ^ (b & mask)).bit_count() <= 2 for a, b in pairs)
    roots = {r.node & mask: r.root for r in components(links).collect()}
    want = classes({c & mask for c in signed})
    for x in want:
        for y in want:
            assert (roots.get(x, x) == roots.get(y, y)) == (want[x] == want[y])


def test_near_duplicates(docs, messy):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(50 + i, base.replace(f"word{i * 7} ", f"other{i} ")) for i in range(12)] + [(80, base.upper()), (81, base), (82, "quite different words")]
    rows += [r for r in messy if r[0] is not None]
    got = sorted(map(tuple, simhash.near_duplicates(docs(rows, clash=True)).collect()), key=str)
    codes = {d: fingerprint(t) for d, t in rows}
    group = classes(set(codes.values()))
    least = {}
    for d, c in codes.items():
        least[group[c]] = min(least.get(group[c], d), d)
    assert got == sorted(((d, format(fingerprint(t), "016x"), least[group[codes[d]]]) for d, t in rows), key=str)
    assert len({g[2] for g in got if 50 <= g[0] < 82}) < 14


def test_near_duplicates_null_keys_and_empty(docs):
    got = simhash.near_duplicates(docs([(None, "a b c"), (None, "a b c"), (4, "a b c"), (None, None)])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got if r.fingerprint != "0" * 16) == [(False, 4), (True, 4), (True, 4)]
    assert [r.component_id for r in got if r.fingerprint == "0" * 16] == [None]
    assert simhash.near_duplicates(docs([])).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)] + [(201, 200), (201, 199)]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {199: 199, 200: 199, 201: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_registered_simhash_equals_brute_force(spark, sf):
    import __spark_entry__ as entry

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    codes = {d: fingerprint(t) for d, t in rows}
    group = classes(set(codes.values()))
    least = {}
    for d, c in codes.items():
        least[group[c]] = min(least.get(group[c], d), d)
    got = sorted(map(tuple, entry.queries()["op3_simhash"](spark, sf).collect()))
    assert got == sorted((d, format(c, "016x"), least[group[c]]) for d, c in codes.items())
