"""Near copies at similarity 0.8, against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webframe.llm import near_copies


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    rows = [(i, sets(t)) for i, t in rows]
    root = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i < j and len(a & b) >= 0.8 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    return root


def copies(seed=5):
    """Groups of edited copies: one word in forty to one in three hundred is another."""
    rng, rows = random.Random(seed), []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for k in range(8):
            text = [w if rng.random() > (k % 4) / 160 else f"e{rng.randrange(9999)}" for w in base]
            rows.append((g * 100 + k, " ".join(text)))
    return rows


def test_near_copies_equal_brute_force(docs, messy):
    rows = copies() + [(5000 + i, t) for i, t in messy if i not in (None, 6, 10)]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(rows, clash=True)).collect()}
    want = brute(rows)
    assert got == want and 12 < len(set(want.values())) < len(rows)


def test_members_that_the_smallest_does_not_reach_are_compared(docs):
    base = [f"w{i}" for i in range(400)]

    def edit(places):
        return " ".join(f"e{i}" if i in places else w for i, w in enumerate(base))

    rows = [(k, edit(set(range(20 * k, 20 * k + 20)))) for k in range(12)]  # neighbours of the plain text, not all of each other
    rows += [(50, edit(set(range(0, 40)) | set(range(200, 240)))), (51, edit(set(range(0, 40)) | set(range(204, 244))))]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(rows)).collect()}
    assert got == brute(rows)


def test_nulls_and_repeated_rows(docs):
    got = sorted(((r.doc_id, r.component_id) for r in near_copies.near_copies(docs([(None, "a b c"), (4, "a B  c"), (4, "a B  c"), (None, None), (2, " "), (None, "z")])).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, 2), (2, 2), (None, None)], key=str)
    assert near_copies.near_copies(docs([])).count() == 0


def test_stage_removes_copies_at_similarity_of_0_8(spark, docs):
    base = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(f"e{i}" if i in (50, 120, 190, 250) else w for i, w in enumerate(base))), (3, " ".join(base[:200] + [f"o{i}" for i in range(100)]))]
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs(rows).withColumn("lang", F.lit("en")), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def crowded_copies(seed=9):
    """Short texts of one base: most pairs lie a little below the similarity that links, some edits are shared, some texts are cut."""
    rng, rows = random.Random(seed), []
    base = [f"w{i}" for i in range(40)]
    for k in range(150):
        text = list(base)
        for _ in range(1 + k % 3 // 2):
            text[rng.randrange(40)] = f"e{rng.randrange(12) if k % 4 == 0 else 100 + k}"
        rows.append((k, " ".join(text[rng.randrange(3):] if k % 5 == 0 else text)))
    return rows


@pytest.mark.parametrize("crowd,seed", [(0, 9), (32, 11)])
def test_crowded_keys_equal_brute_force(docs, crowd, seed):
    rows = crowded_copies(seed)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(rows), crowd=crowd).collect()}
    assert got == brute(rows) and 100 < len(set(got.values())) < 140


def test_pairs_to_compare_do_not_grow_with_the_square_of_a_group(docs, monkeypatch):
    rng, compared, alike = random.Random(3), [], near_copies._alike

    def counted(pairs, *args):
        compared.append(pairs.count())
        return alike(pairs, *args)

    monkeypatch.setattr(near_copies, "_alike", counted)
    rows = []
    for k in range(300):
        text = [f"w{i}" for i in range(40)]
        text[rng.randrange(5, 35)] = f"e{k}"
        rows.append((k, " ".join(text)))
    got = near_copies.near_copies(docs(rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows)
    assert sum(compared) < 30 * len(rows)  # all pairs are 45,000


def test_copies_of_a_missing_text_meet_a_hub_not_each_other(docs, monkeypatch):
    """Up to four words in 150 are others: the text of smallest code seldom reaches all that are alike."""
    rng, compared, alike = random.Random(1), [], near_copies._alike

    def counted(pairs, *args):
        compared.append(pairs.count())
        return alike(pairs, *args)

    monkeypatch.setattr(near_copies, "_alike", counted)
    rows = []
    for k in range(400):
        text = [f"w{i}" for i in range(150)]
        for _ in range(rng.randrange(5)):
            text[rng.randrange(150)] = f"e{k}_{rng.randrange(99)}"
        rows.append((k, " ".join(text)))
    got = near_copies.near_copies(docs(rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows)
    assert sum(compared) < 15 * len(rows)  # all pairs are 79,800


def test_folded_sets_differ_in_no_more_bits_than_items(spark):
    rng, pairs = random.Random(4), []
    for k in range(60):
        both = [rng.getrandbits(64) - 2**63 for _ in range(rng.randrange(200))]
        pairs.append((both + [rng.getrandbits(64) - 2**63 for _ in range(k)], both + [rng.getrandbits(64) - 2**63 for _ in range(k // 2)]))
    d = spark.createDataFrame(pairs, "x array<bigint>, y array<bigint>").select("x", "y", near_copies._folded("x").alias("fx"), near_copies._folded("y").alias("fy"))
    for r in d.collect():
        bits, items = sum((a ^ b).bit_count() if a ^ b >= 0 else ((a ^ b) + 2**64).bit_count() for a, b in zip(r.fx, r.fy, strict=True)), len(set(r.x) ^ set(r.y))
        assert bits <= items and bits >= items / 2 and len(r.fx) == near_copies.WORDS
