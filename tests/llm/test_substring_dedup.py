"""Repeated word windows by recompression, against a plain restatement."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from webframe.llm import recompression, substring_dedup
from webframe.llm.substring_dedup import dedup_windows, kept_words


def result(df):
    d = df.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("sha"))
    return sorted(map(tuple, d.collect()), key=str)


def planted(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["the", "of", "a"] * 15
    passages = [rng.choices(vocab, k=n) for n in (19, 20, 21, 25, 40, 150)]
    passages += [["x"] * 60, ["x", "y"] * 30, (["x"] * 5 + ["y"] * 3) * 8]
    rows = []
    for i in range(60):
        words = rng.choices(vocab, k=rng.choice([0, 5, 30, 200]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((100 + i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_windows(docs, messy, seed):
    rows = planted(seed) + [r for r in messy if r[0] not in (None, 6, 10)]
    rows += [(900 + i, rows[seed][1]) for i in range(7)] + [(950, " ".join(["x"] * 3000)), (951, " ".join(["x"] * 2999))]
    got = result(dedup_windows(docs(rows, clash=True)))
    assert got == sorted(kept_words(rows), key=str)
    assert sum(r[2] > 0 for r in got) > 10


def test_small_windows_and_pieces(docs, monkeypatch):
    rows = planted(4)
    assert result(dedup_windows(docs(rows), size=3)) == sorted(kept_words(rows, 3), key=str)
    monkeypatch.setattr(substring_dedup, "PIECE", 50)
    texts = [b"a b  c d e " * 200, b"", b"f", b"g\nh " * 3, b"x" * 500 + b" y" * 40]
    found = [(int(r), int(p), int(n)) for row, place, _, count, *_ in substring_dedup._found(iter(texts), 20) for r, p, n in zip(row, place, count, strict=True)]
    windows = sorted((r, x) for r, p, n in found for x in range(p, p + n))
    assert windows == [(0, x) for x in range(981)] + [(4, x) for x in range(22)]
    assert result(dedup_windows(docs(rows))) == sorted(kept_words(rows), key=str)


def test_words_are_those_of_split():
    texts = [b" a  b\tc\x0b", b"", b"d", b"\xc2\xa0e\x1cf g", b"h" * 200 + b" i", b"\n", b"h" * 200]
    data, begins = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])[:-1]
    start, end, text, lanes = recompression.word_digests(data, begins)
    assert [(int(t), data[a:b].tobytes()) for t, a, b in zip(text, start, end, strict=True)] == [(k, w) for k, t in enumerate(texts) for w in t.split()]
    assert lanes[0][-1] == lanes[0][-3] and len(set(lanes[0].tolist())) == len(start) - 1
    assert len(recompression.word_digests(data[:0], begins[:1])[0]) == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    words = [b"v%d" % i for i in rng.zipf(1.3, 6000) % 50]
    words[1000:1100] = words[3000:3100]
    words[5000:5200] = [b"q"] * 200
    data = np.frombuffer(b" ".join(words), np.uint8)
    *_, lanes = recompression.word_digests(data, np.array([0]))
    first, count, anchor, *_ = recompression.stretches(lanes, np.zeros(len(words), bool), 20)
    assert count.sum() == len(words) - 19 and (np.cumsum(count)[:-1] == first[1:]).all()
    by_window = {}
    for a, p in zip(np.repeat(anchor, count), range(len(words) - 19), strict=True):
        assert by_window.setdefault(tuple(words[p:p + 20]), a) == a


def test_repeated_and_null_keys(docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = result(dedup_windows(docs([(None, a), (1, a), (1, b), (1, b), (2, b), (None, None), (3, "")])))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(None, 30, 0, sha(a)), (1, 30, 30, sha("")), (1, 30, 0, sha(b)), (1, 30, 0, sha(b)), (2, 30, 30, sha("")), (None, 0, 0, sha("")), (3, 0, 0, sha(""))]
    assert got == sorted(want, key=str)
    assert dedup_windows(docs([])).count() == 0


def test_long_repeated_text_of_messy_rows(docs, messy):
    rows = [r for r in messy if r[0] == 10] + [(20, messy[12][1])]
    assert result(dedup_windows(docs(rows))) == sorted(kept_words(rows), key=str)


def test_registered_query_equals_plain_windows(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = entry.queries()["op11_substring_dedup"](spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == sorted(kept_words(rows))
