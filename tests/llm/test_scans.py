"""Secret and licence scans."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from webframe.llm import license_scan, secret_scan


def test_secret_scan_removes_false_positives(spark, docs, messy):
    rows = []
    for i in range(120):
        key = "".join("0123456789abcdef"[(i * 7 + j * j * (i + 3)) % 16] for j in range(40))
        card, mail = str(4_000_000_000_000_000 + i * 7_919), f"name.{i}@mail{i}.example.com"
        rows += [(100 + i, f'text token = "{key}" and {card} or {mail}, at 10.0.{i}.200:8080'), (300 + i, f"AKIA{i:04d}QWERTZUIOPAS then {card}")]
    got = secret_scan.scan(docs(rows + [m for m in messy if m[0] not in (10, 11)], clash=True)).collect()
    kinds = {(bool(re.fullmatch("[0-9a-f]{40}|AKIA.{16}", r.value)), r.is_secret) for r in got if r.doc_id is not None and r.doc_id >= 100}
    assert kinds == {(True, True), (False, False)}
    first = next(r for r in got if r.doc_id == 100 and "mail" in r.value)
    assert (first.pos, first.nth, first.value) == (7, 0, "name.0@mail0.example.com")


def test_secret_features(spark, docs):
    d = docs([(1, "my password=abcabc123456XY next"), (2, None)]).withColumn("p", F.lit("src/tests/a.py"))
    r = secret_scan.with_features(secret_scan.candidates(d, path="p"), d, common=1).collect()
    assert len(r) == 1 and r[0].value == "abcabc123456XY" and r[0].before == "my" or r[0].before == " my"
    assert (r[0].length, r[0].key_near, r[0].assigned, r[0].sample_path, r[0].path_depth) == (14, 1, 1, 1, 2)
    assert abs(r[0].transitions - 2 / 14) < 1e-9 and abs(r[0].covered - 6 / 14) < 1e-9


def test_secret_scan_with_own_labels_and_without_any(spark, docs):
    d = docs([(1, "aaaabbbbcccc1 and dddd1111eeee"), (2, ""), (3, None)])
    assert {r.is_secret for r in secret_scan.scan(d).collect()} == {False}
    found = secret_scan.with_features(secret_scan.candidates(d), d).withColumn("label", F.lit(1))
    assert {r.is_secret for r in secret_scan.scan(d, labelled=found).collect()} == {True}
    assert secret_scan.scan(d.limit(0)).count() == 0


def words(t):
    return [w for w in re.split(license_scan.WORD_SPLIT, (t or "").lower()) if w]


def brute(rows, threshold=license_scan.THRESHOLD):
    df, n = Counter(), len(rows)
    for _, t in rows:
        df.update(set(words(t)))
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1

    def vector(t):
        v = {w: k * idf(w) for w, k in Counter(words(t)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    known = [(i, name, vector(t)) for i, (name, t) in enumerate(license_scan.TEMPLATES)]
    out = {}
    for d, t in rows:
        units = [(-1, t), *enumerate((t or "").split("\n"))] if t is not None else []
        best = max(((round(sum(x * y.get(w, 0) for w, x in vector(u).items()), 9), -k, -i, name) for k, u in units for i, name, y in known), default=None)
        if best and best[0] >= threshold - 1e-9:
            out[d] = best[3]
    return out


def test_own_licenses_equal_brute_force(docs, messy):
    rows = [(20 + i, f"Some text of file {i}\n// {t}\nmore text here") for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    rows += [(60, "licensed under nothing at all, really"), (61, "the license of the version"), (62, license_scan.TEMPLATES[5][1].replace(", ", "\n"))]
    rows += [m for m in messy if m[0] not in (None, 6)]
    got = {r.doc_id: r.license for r in license_scan.own_licenses(docs(rows, clash=True)).collect()}
    assert got == brute(rows) and len(got) >= len(license_scan.TEMPLATES)


def test_nearest_directory_gives_its_license(spark):
    mit, gpl = license_scan.TEMPLATES[0][1], license_scan.TEMPLATES[4][1]
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/c/file", "x y"), (3, "a/b/COPYING.txt", gpl), (4, "a/b/own", mit), (5, "z/file", "x"),
        (6, "a/file", None), (7, None, "x"), (8, "a/bc/file", "q"), (9, "top", "q"), (None, "a/b/n", ""), (2, "a/b/c/file", "x y"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("own column"))
    got = sorted(((r.doc_id, r.license, r.origin, r.directory) for r in license_scan.scan(d).collect()), key=str)
    assert got == sorted([
        (1, "MIT", "own", None), (2, "GPL-3.0", "inherited", "a/b"), (2, "GPL-3.0", "inherited", "a/b"), (3, "GPL-3.0", "own", None),
        (4, "MIT", "own", None), (5, None, "none", None), (6, "MIT", "inherited", "a"), (7, None, "none", None),
        (8, "MIT", "inherited", "a"), (9, None, "none", None), (None, "GPL-3.0", "inherited", "a/b"),
    ], key=str)
    assert license_scan.scan(d.limit(0)).count() == 0


def test_root_directory_and_equal_scores(spark):
    rows = [(1, "LICENSE", license_scan.TEMPLATES[0][1]), (2, "NOTICE", license_scan.TEMPLATES[2][1]), (3, "deep/er/file", "q")]
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: "MIT", 2: "Apache-2.0", 3: "Apache-2.0"}
