import json

from pyspark.sql import functions as F

from webframe.operators.items import dedupe_any, growth_stop
from webframe.operators.rules import Field, Rule
from webframe.sources.captures import stream_captures
from webframe.streaming import jobs as J


def run(df, spark, tmp_path, mode="append", name="out"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / ("cp_" + name))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_dedupe_equals_batch(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    got = run(J.stream_dedupe(src.withColumn("ts", F.col("ts").cast("timestamp")), ["event_type", "props"], delay="1000 days"), spark, tmp_path, name="dd")
    want = dedupe_any(spark.read.parquet(f"{sf}/events.parquet"), ["event_type", "props"])
    assert {r[0] for r in got.select("content_hash").collect()} == {r[0] for r in want.select("content_hash").collect()}


def test_stats_equal_batch(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    rows = [{"id": str(i), "timestamp": 1_700_000_000 + i * 60, "url": "http://h", "mime_type": "a" if i % 2 else "", "failed": i % 5 == 0} for i in range(60)]
    (folder / "a.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    got = run(J.stream_stats(stream_captures(spark, str(folder))), spark, tmp_path, "complete", "st").collect()
    from webframe.sources.captures import read_captures

    batch = J.stats_by_window(read_captures(spark, str(folder)).withColumn("ts", F.timestamp_seconds("timestamp"))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and sum(r["total"] for r in got) == 60


def test_growth_equals_batch(spark, tmp_path):
    rows = [(1, r, h, 100) for r, h in enumerate([1000, 2000, 3000, 3000, 3010, 3010])] + [(2, r, 1000 * (r + 1), 10 * r) for r in range(9)]
    df = spark.createDataFrame(rows, "page_id bigint, round int, height int, nodes int")
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    got = run(J.stream_growth_stop(spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))), spark, tmp_path, name="gs")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, growth_stop(df).select(got.columns).collect()))


def test_correlation(spark, tmp_path):
    req = spark.createDataFrame([("1", 10), ("2", 20), ("9", 100000)], "id string, s int").select("id", F.timestamp_seconds("s").alias("ts"))
    end = spark.createDataFrame([("1", 11), ("9", 100001)], "id string, s int").select("id", F.timestamp_seconds("s").alias("end_ts"), F.lit(200).alias("status"), F.lit(False).alias("failed"))
    req.coalesce(1).write.parquet(str(tmp_path / "r"))
    end.coalesce(1).write.parquet(str(tmp_path / "e"))
    r, e = (spark.readStream.schema(d.schema).parquet(str(tmp_path / n)) for d, n in ((req, "r"), (end, "e")))
    got = {x["id"]: (x["status"], x["duration_ms"]) for x in run(J.stream_correlate(r, e), spark, tmp_path, name="co").collect()}
    assert got["1"] == (200, 1000.0) and got["9"] == (200, 1000.0) and got.get("2", (None, None)) == (None, None)


def test_extraction_in_batches(spark, sf, tmp_path):
    rule = Rule("nav li", (Field("t", "a"), Field("link", "a", "href", ("url",))))
    out = str(tmp_path / "items")
    write = J.extract_batch(rule, lambda df, epoch: df.write.mode("append").parquet(out))
    src = spark.readStream.schema("page_id bigint, url string, html string").option("pathGlobFilter", "pages.parquet").parquet(sf)
    q = src.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    write(spark.read.parquet(f"{sf}/pages.parquet"), 0)
    both = spark.read.parquet(out)
    assert both.count() == 2 * both.distinct().count() > 0


def test_growth_with_rounds_in_any_order(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows = []
    for page in range(20):
        h = 1000
        for r in range(10):
            rows.append((page, r, h, 100 + r))
            h += rng.choice([0, 10, 500])
    shuffled = rows[:]
    rng.shuffle(shuffled)
    schema = "page_id bigint, round int, height int, nodes int"
    for k in range(4):
        spark.createDataFrame(shuffled[k::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = run(J.stream_growth_stop(src, idle=None), spark, tmp_path, name="gs2")
    want = growth_stop(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_store_replays_and_touches_few_partitions(spark, tmp_path):
    from webframe.sources import sinks as S

    path = str(tmp_path / "store")
    rows = lambda a, b: spark.createDataFrame([(i, f"text {i}") for i in range(a, b)], "seq int, t string")
    write = S.upsert_stream_batch(path, ["t"])
    write(rows(0, 300), 0)
    write(rows(0, 300), 0)
    files = {f for f in (tmp_path / "store").rglob("*.parquet")}
    write(rows(300, 302), 1)
    after = {f for f in (tmp_path / "store").rglob("*.parquet")}
    assert len(files - after) <= 2 and len(after - files) <= 2
    write(rows(250, 310), 2)
    write(rows(300, 400), 1)  # an epoch that is done
    got = S.read_store(spark, path)
    assert got.count() == 310 and sorted(r.id for r in got.collect()) == list(range(1, 311))
    assert got.select("content_hash").distinct().count() == 310
    assert len({f for f in (tmp_path / "store").rglob("*.parquet")}) <= 256
    S.upsert_ignore(rows(0, 0), str(tmp_path / "none"), ["t"])
    assert S.read_store(spark, str(tmp_path / "none")).count() == 0


def test_growth_stop_reads_no_rounds_that_decide_nothing(spark, tmp_path):
    series = spark.readStream.schema("page_id bigint, round int, height int, nodes int").parquet(str(tmp_path))
    plan = J.stream_growth_stop(series, max_rounds=3)._jdf.queryExecution().analyzed().toString()
    assert "<= 3)" in plan
