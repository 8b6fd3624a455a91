"""Spelling variants against all pairs compared letter by letter."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from webframe.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_vocabulary(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(rows):
    n = plain_vocabulary(rows)
    forms, out = {}, []
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and edits(v, w) == 1] for w in n}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(near[w]), n.get(forms[w])))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    base = ["walking", "talking", "stalking", "Straße", "façade", "facade", "aaaaa", "aaaaaa", "aaaaaaa", "a" * 17, "a" * 18, "zzzzzzz", "naïve"]
    base += ["".join(rng.choices("abcdeé", k=rng.choice([5, 6, 7]))) for _ in range(60)]
    base += ["long" * 9 + "x", "long" * 9, "lung" + "long" * 8]
    rows = []
    for i in range(120):
        words = []
        for w in rng.choices(base, weights=[1 + 40 // (k + 1) for k in range(len(base))], k=40):
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abzé") + w[at:], w[:at] + rng.choice("abzé") + w[at + 1:]])
            words.append(rng.choice([w, w.upper(), w + "9"]))
        rows.append((i, rng.choice([" ", ", ", "\n×"]).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "cell"), [(1, spelling.CELL), (2, 7)])
def test_equals_all_pairs(docs, messy, seed, cell):
    rows = corpus(seed) + messy
    want = plain(rows)
    got = spelling.variants(docs(rows, clash=True), cell=cell)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len(want) > 100 and sum(w[1] is not None for w in want) > 20 and any(w[2] not in (w[0], w[1]) for w in want)


def test_one_edit_both_ways():
    rng = random.Random(0)
    words = ["".join(rng.choices("ab", k=rng.randint(5, 8))) for _ in range(150)] + ["a" * 23, "a" * 24, "a" * 25, "a" * 26, "b" + "a" * 24]
    x = spelling.Spelled(words)
    i, j = (g.ravel() for g in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    want = [edits(words[p], words[q]) == 1 for p, q in zip(i, j, strict=True)]
    assert spelling.verified(x, i, x, j).tolist() == want
    assert [spelling.one_edit(words[p], words[q]) for p, q in zip(i, j, strict=True)] == want


def test_search_meets_every_pair_once():
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("aeinxq", k=rng.randint(5, 7))) for _ in range(300)})
    n = np.arange(len(words))
    pairs = []
    for rows, _, spent in spelling._searches(spelling.vectors(words)):
        if spent == 0:
            assert len(rows) == len(words)
    own = spelling.vectors(words)
    full = spelling.Trie(own)
    x = spelling.Spelled(words)
    for at, leaf, s in full.search(own, np.zeros(len(words), np.int64)):
        count, j = full.words_at(leaf)
        i = np.repeat(at, count)
        ok = spelling.verified(x, i, x, j)
        pairs += [(words[p], words[q]) for p, q in zip(i[ok], j[ok], strict=True) if s or words[p] < words[q]]
    assert len(n) == len(words)
    assert sorted(tuple(sorted(p)) for p in pairs) == sorted((a, b) for a in words for b in words if a < b and edits(a, b) == 1)


def test_empty_and_null(docs):
    assert spelling.variants(docs([])).count() == 0
    assert spelling.variants(docs([(1, None), (None, ""), (2, "few few few")])).count() == 0
    got = spelling.variants(docs([(None, "alone alone"), (3, "alone"), (3, "alone")])).collect()
    assert [tuple(r) for r in got] == plain([(None, "alone alone"), (3, "alone"), (3, "alone")])
