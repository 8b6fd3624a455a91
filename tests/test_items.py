import random

from pyspark.sql import functions as F

from webframe.operators import items as I
from webframe.operators import repair as P
from webframe.operators import runs as N
from webframe.operators.rules import Field, Rule
from webframe.plans.ordering import running_sum, sequence_number, top_per_key
from webframe.sources import sinks as S


def skewed(spark, n=900):
    """One key owns most rows; ties in the first order column occur."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", rng.randrange(n // 2), i, rng.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, o int, id int, v double")


def test_positions_and_sums_match_brute_force(spark):
    rows, df = skewed(spark)
    want_rn, want_sum = {}, {}
    for key in {r[0] for r in rows}:
        total = 0.0
        for i, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            total += r[3]
            want_rn[r[2]], want_sum[r[2]] = i, total
    assert {r["id"]: r["rn"] for r in sequence_number(df, ["k"], ["o", "id"], ranges=8).collect()} == want_rn
    got = {r["id"]: r["s"] for r in running_sum(df, ["k"], ["o", "id"], "v", "s", ranges=8).collect()}
    assert all(abs(got[i] - want_sum[i]) < 1e-9 for i in want_sum)
    whole = sequence_number(df, [], ["o", "id"], ranges=8).orderBy("rn").collect()
    assert [r["id"] for r in whole] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]


def test_top_per_key_both_ways(spark):
    rows, df = skewed(spark)
    want = {r[2] for k in {r[0] for r in rows} for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))[:7]}
    order = [F.col("o"), F.col("id")]
    assert {r["id"] for r in top_per_key(df, ["k"], order, 7).collect()} == want
    plan = top_per_key(df, ["k"], order, 7)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "3")
    try:
        assert {r["id"] for r in top_per_key(df, ["k"], order, 7).collect()} == want
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1000")


def test_dedupe_is_idempotent_and_keeps_the_first(spark):
    d = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, None, None), (4, "", None), (5, "a", "x")], "seq int, t string, u string")
    once = I.dedupe_first(d, ["t", "u"], ["seq"])
    assert sorted(r["seq"] for r in once.collect()) == [1, 5]
    again = I.dedupe_first(once.drop("content_hash"), ["t", "u"], ["seq"])
    assert sorted(r["seq"] for r in again.collect()) == [1, 5]
    assert "WindowGroupLimit" in once._jdf.queryExecution().executedPlan().toString()


def test_store_ignores_what_it_has(spark, tmp_path):
    path = str(tmp_path / "store")
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "seq int, t string")
    S.upsert_ignore(d, path, ["t"], "http://u")
    S.upsert_ignore(d, path, ["t"], "http://u")
    S.upsert_stream_batch(path, ["t"], "http://u")(spark.createDataFrame([(9, "c"), (8, "b")], "seq int, t string"), 0)
    rows = spark.read.parquet(path).orderBy("id").collect()
    assert [(r["id"], r["data"]) for r in rows] == [(1, '{"t":"a"}'), (2, '{"t":"b"}'), (3, '{"t":"c"}')]
    assert [r["id"] for r in S.fetch_recent(spark.read.parquet(path), 2).collect()] == [3, 2]


def test_file_formats_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "a,\"q\"", ["x", "y"]), (2, None, None)], "id int, t string, l array<string>").coalesce(1)
    for fmt in ("json", "jsonl", "parquet"):
        path = str(tmp_path / fmt)
        S.write_items(d, path, fmt)
        S.write_items(d, path, fmt)
        back = spark.read.parquet(path) if fmt == "parquet" else spark.read.schema("id int, t string, l array<string>").option("multiLine", fmt == "json").json(path)
        assert back.count() == (4 if fmt == "jsonl" else 2)
    S.write_items(d, str(tmp_path / "csv"), "csv")
    part = next((tmp_path / "csv").glob("*.csv")).read_text("utf-8-sig").splitlines()
    assert part[0] == "id,t,l" and part[1].startswith('1,"a,""q""","[""x"",""y""]"')
    both = S.union_items(d.select("id"), spark.createDataFrame([(5, "n")], "id int, extra string"))
    assert both.columns == ["id", "extra"] and both.count() == 3


def test_url_groups_and_deletion(spark, tmp_path):
    runs = spark.createDataFrame(
        [(1, "http://a/x", "crawl", 3, "2024-01-01 00:00:00"), (2, "http://a/x", "analyze", 0, "2024-01-03 00:00:00"), (3, "http://b/y", "crawl", 5, "2024-01-02 00:00:00"), (4, "", "requests", 0, "2024-01-01 00:00:00")],
        "run_id int, url string, kind string, item_count int, created_at string",
    ).withColumn("created_at", F.to_timestamp("created_at"))
    files = spark.createDataFrame([(1, "p", 10), (1, "q", 5), (3, "r", 7)], "run_id int, path string, bytes int")
    got = {r["group_key"]: r for r in N.url_groups(runs, files).collect()}
    assert got["http://a/x"]["run_count"] == 2 and got["http://a/x"]["bytes"] == 15 and got["http://a/x"]["kinds"] == ["analyze", "crawl"]
    assert got["(no url)::requests"]["file_count"] == 0 and got["http://b/y"]["host"] == "b"
    pos = {r["run_id"]: r["position"] for r in N.url_group_runs(runs, files).collect()}
    assert pos == {2: 1, 1: 2, 3: 1, 4: 1}
    path = str(tmp_path / "by_url")
    data = spark.createDataFrame([("http://a/x", 1), ("http://a/x", 2), ("http://a/x/", 3), ("http://b/y", 4)], "url string, v int")
    S.write_by_url(data, path)
    busy = runs.withColumn("status", F.lit("running"))
    assert S.delete_url_group(spark, path, "http://a/x", busy)["ok"] is False
    out = S.delete_url_group(spark, path, "http://a/x", runs.withColumn("status", F.lit("done")))
    assert out["ok"] and out["removed_rows"] == 2 and out["freed_bytes"] > 0
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [3, 4]
    assert S.delete_url_group(spark, path, "http://none/", None)["ok"] is False


def test_limits(spark):
    limits = spark.createDataFrame([(1, 50, 20), (2, 5, 20), (3, None, 20), (4, 100, None)], "run_id int, run_limit int, max_items int")
    items = spark.createDataFrame([(r, i) for r in (1, 2, 3, 4, 5) for i in range(30)], "run_id int, seq int")
    got = I.limit_per_run(items, limits, 10, ["seq"]).groupBy("run_id").agg(F.count("*").alias("n"), F.first("limit_source").alias("s")).collect()
    assert {r["run_id"]: (r["n"], r["s"]) for r in got} == {1: (30, "run_limit"), 2: (5, "run_limit"), 3: (20, "max_items"), 4: (30, "run_limit"), 5: (10, "default")}


def test_growth(spark):
    rows = [(1, r, h, 100) for r, h in enumerate([1000, 2000, 3000, 3000, 3010, 3010, 9999])]
    rows += [(2, r, 1000 * (r + 1), 10 * r) for r in range(9)]
    rows += [(3, r, 500, 5) for r in range(3)]
    got = {r["page_id"]: tuple(r)[1:] for r in I.growth_stop(spark.createDataFrame(rows, "page_id bigint, round int, height int, nodes int")).collect()}
    assert got == {1: (4, "settled", True, 2010, 0), 2: (8, "infinite", True, 8000, 80), 3: (2, "settled", False, 0, 0)}


def test_merging_and_names(spark):
    base = spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], "k string, v int, seq int")
    new = spark.createDataFrame([("b", 9, 0), ("c", 3, 1), ("b", 10, 2)], "k string, v int, seq int")
    rows = [(r["k"], r["v"]) for r in I.upsert_latest(base, new, ["k"]).orderBy("seq").collect()]
    assert rows == [("a", 1), ("b", 10), ("c", 3)]
    f = spark.createDataFrame([(i, "d", "A", "T", f"h{i}.mp3") for i in range(3)] + [(9, "d", "", "", "x.mp3")], "id int, folder string, artist string, title string, filename string")
    assert {r["id"]: r["new_name"] for r in I.unique_names(f, ["id"]).collect()} == {0: "A - T.mp3", 1: "A - T (2).mp3", 2: "A - T (3).mp3", 9: "x.mp3"}
    seen = spark.createDataFrame([("h1", 1), ("h2", 2)], "content_hash string, seq bigint")
    state = I.seen_after(seen, spark.createDataFrame([("h2", 1), ("h3", 2), ("h4", 3)], "content_hash string, seq bigint"), 3)
    assert {r["content_hash"] for r in state.collect()} == {"h2", "h3", "h4"}
    d = spark.createDataFrame([(1, {"x": "1"}), (2, {"y": None})], "seq int, data map<string,string>")
    assert [r["column"] for r in I.infer_columns(d).collect()] == ["x", "y"]
    got = {r["seq"]: r["data"] for r in I.add_map_fields(d, {"x": "9", "y": "8"}).collect()}
    assert got == {1: {"x": "1", "y": "8"}, 2: {"x": "9", "y": None}}


def test_rule_fields_are_completed_and_pruned(spark):
    rule = spark.createDataFrame([(1, "song_name", "a", None, "ai"), (2, "t", "a", None, "manual")], "rule_id int, name string, selector string, attribute string, source string")
    analysed = spark.createDataFrame(
        [(1, "title", "a", None), (1, "artist", "b", None), (1, "s-fc7", "i", None), (2, "artist", "b", None)], "rule_id int, name string, selector string, attribute string"
    )
    out = P.merge_fields(rule, analysed)
    assert sorted((r["rule_id"], r["name"]) for r in out.collect()) == [(1, "artist"), (1, "song_name"), (2, "t")]
    r = Rule("li", (Field("song_name", "a"), Field("title", "a b"), Field("artist", "x"), Field("album", "y")))
    rows = spark.createDataFrame([("A", "A", None, "1"), ("B", "B", "", "2")], "song_name string, title string, artist string, album string")
    fixed = P.validate_fields(rows, r, {"artist": ("p.artist", None)})
    assert [(f.name, f.selector) for f in fixed.fields] == [("song_name", "a"), ("artist", "p.artist"), ("album", "y")]


def test_files_and_status(spark):
    f = spark.createDataFrame(
        [(1, "song_ab12.mp3", 10, True), (2, "song_cd34.mp3", 30, True), (3, "song_ef56.mp3", 30, True), (4, "other.mp3", 1, True), (5, "song_x.mp3", 99, False)],
        "file_id int, filename string, size int, ok boolean",
    )
    assert {r["file_id"] for r in N.keep_largest_by_stem(f).where("not keep").collect()} == {1, 3}
    e = spark.createDataFrame([(["download of x failed", "boom"],)], "errors array<string>").select(N.split_errors().alias("e")).first()["e"]
    assert (e["core"], e["download"]) == (["boom"], ["download of x failed"])


def test_no_limits_unless_asked(spark):
    d = spark.range(700).selectExpr("id as seq", "if(id = 650, map('x', 'a', 'late', 'b'), map('x', 'a')) as data")
    assert [r["column"] for r in I.infer_columns(d).collect()] == ["x", "late"]
    assert [r["column"] for r in I.infer_columns(d, sample=200).collect()] == ["x"]
    old = spark.range(21_000).selectExpr("concat('h', id) as content_hash", "id as seq")
    new = spark.createDataFrame([("n", 1)], "content_hash string, seq bigint")
    assert I.seen_after(old, new).count() == 21_001
    names = spark.range(60).selectExpr("id", "'f' as folder", "'a' as artist", "'t' as title", "concat(id, '.mp3') as filename")
    assert {r["new_name"] for r in I.unique_names(names, ["id"]).collect()} == {"a - t.mp3", *(f"a - t ({i}).mp3" for i in range(2, 61))}


def test_store_takes_the_first_of_equal_rows_and_keeps_old_partitions(spark, tmp_path):
    path = str(tmp_path / "store-keys")
    rows = lambda *r: spark.createDataFrame(list(r), "seq int, t string")
    S.upsert_ignore(rows((3, "b"), (1, "a"), (2, "a"), (1, "a")), path, ["t"])
    S.upsert_ignore(rows((1, "a"), (5, "c"), (4, "b"), (6, "c")), path, ["t"])
    got = sorted((r["id"], r["data"]) for r in S.read_store(spark, path).collect())
    assert got == [(1, '{"t":"a"}'), (2, '{"t":"b"}'), (3, '{"t":"c"}')]


def test_a_folder_is_written_by_one_task(spark, tmp_path):
    path = str(tmp_path / "by-url")
    S.write_by_url(spark.range(40).selectExpr("id", "concat('http://h/', id % 2) AS url").repartition(8), path)
    files = list((tmp_path / "by-url").glob("*/part-*"))
    assert len(files) == 2 and spark.read.parquet(path).count() == 40
