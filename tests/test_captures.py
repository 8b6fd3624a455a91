import json

from pyspark.sql import functions as F

from webframe.operators import captures as C
from webframe.operators.extract import extract_json, finish_rows
from webframe.operators.rules import Field, Rule
from webframe.plans.steps import Step, register_jsonpath_rows, row_step, run_steps
from webframe.sources.captures import read_captures, read_sockets


def test_log_is_read_with_defaults(spark, tmp_path):
    lines = [
        {"id": "1", "timestamp": 1.5, "url": "http://h/api/a", "status": 200, "mime_type": "application/json", "body_text": '{"data":{"list":[{"p":"1,5"},{"p":null}]}}', "page_url": "http://h/p", "response_headers": {"content-length": "40"}},
        {"id": "2", "timestamp": 2.5, "url": "data:xx", "resource_type": "xhr", "mime_type": "text/plain", "body_text": "[1]"},
        {"id": "3", "timestamp": 3.5, "url": "http://h/b", "resource_type": "image", "failed": True, "error": "x"},
        {"id": "4", "timestamp": 4.5, "url": "http://h/big", "mime_type": "application/json", "body_text": "[2]", "response_headers": {"content-length": "9000000"}},
        {"id": "5", "timestamp": 5.5, "url": "http://h/t", "mime_type": "text/html", "body_text": "{}"},
    ]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\n{broken\n")
    df = C.parse_body(read_captures(spark, str(tmp_path), keep_bad=False)).cache()
    assert df.count() == 5 and read_captures(spark, str(tmp_path)).count() == 6
    assert {r["id"] for r in df.where("body_json is not null").collect()} == {"1", "2", "4"}
    bounded = C.parse_body(read_captures(spark, str(tmp_path), keep_bad=False), 1_000_000)
    assert {r["id"] for r in bounded.where("body_json is not null").collect()} == {"1", "2"}
    assert df.where("id = '4'").first()["body_text"] == "[2]" and bounded.where("id = '4'").first()["body_text"] == ""
    assert df.where("id = '1'").first()["method"] == "GET"
    assert {r["id"] for r in C.capturable(df).collect()} == {"1", "4", "5"}
    assert [r["id"] for r in C.filter_captures(df, r"^http://h/", limit=2).collect()] == ["5", "4"]
    assert [r["id"] for r in C.filter_captures(df, "API/(").collect()] == []
    assert [r["id"] for r in C.filter_captures(df, "h/[A", has_json=False).collect()] == []
    assert {r["id"] for r in C.filter_captures(df, status=0, mime="JSON", has_json=True).collect()} == {"1", "4"}
    s = C.capture_stats(df).first()
    assert (s["total"], s["with_json"], s["failed"], s["websockets"]) == (5, 3, 1, 0) and s["by_mime"]["unknown"] == 1
    assert C.largest_json(df).first()["id"] == "1"
    rule = Rule("$.data.list", (Field("p", "$.p", None, ("float",)), Field("link", "$.p")), mode="json")
    rows = finish_rows(extract_json(df, rule), rule, "page_url").orderBy("item_pos").collect()
    assert [(r["p"], r["link"]) for r in rows if r["id"] == "1"] == [(15.0, "1,5"), (None, None)]


def test_long_bodies_keep_head_and_tail(spark):
    d = spark.createDataFrame([("1", "application/json", "[" + "1," * 500 + "1]", None)], "id string, mime_type string, body_text string, response_headers map<string,string>")
    r = C.parse_body(d, 100).first()
    assert len(r["body_text"]) == 100 and r["body_json"].count("1") == 501


def test_sockets_and_correlation(spark, tmp_path):
    (tmp_path / "w.jsonl").write_text('{"url":"ws://h","frames":[{"direction":"send","payload":"a","timestamp":1.0},{"direction":"recv","payload":"b","timestamp":2.0}],"closed":true}\n')
    frames = C.ws_frames(read_sockets(spark, str(tmp_path))).collect()
    assert [(f["pos"], f["direction"], f["payload"]) for f in frames] == [(0, "send", "a"), (1, "recv", "b")]
    req = spark.createDataFrame([("1", 1.0), ("2", 2.0)], "id string, timestamp double")
    res = spark.createDataFrame([("1", 200)], "id string, status int")
    end = spark.createDataFrame([("1", 1.25, False), ("2", 2.5, True)], "id string, end_ts double, failed boolean")
    got = {r["id"]: (r["status"], r["duration_ms"], r["failed"]) for r in C.correlate(req, res, end).collect()}
    assert got == {"1": (200, 250.0, False), "2": (None, 500.0, True)}


def test_rule_guess(spark):
    bodies = {"a": {"code": 0, "result": {"rows": [{"id": 1, "name": "x", "r": 1.5, "t": "5"}]}}, "b": [{"k": True}], "c": {"x": {"y": [{"z": "1"}]}}, "d": {"n": 1}, "e": {"items": [1, {"q": 2}]}}
    df = spark.createDataFrame([(i, "u", json.dumps(b), json.dumps(b)) for i, b in bodies.items()], "id string, url string, body_text string, body_json string")
    got = {r["id"]: (r["item_selector"], [(f["name"], f["transform"][0]) for f in r["fields"]]) for r in C.guess_json_rule(df).collect()}
    assert got["a"] == ("$.result.rows[*]", [("id", "float"), ("name", "strip"), ("r", "float"), ("t", "strip")])
    assert got["b"] == ("$[*]", [("k", "strip")]) and got["c"] == ("$.x.y[*]", [("z", "strip")]) and got["d"] == ("$", [])
    assert got["e"] == ("$.items[*]", [("q", "float")])


def test_user_steps(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "t string, n int")
    upper = row_step(lambda r: {"t": r["t"].upper(), "x": 1.0 / r["n"]}, "t string, x double")
    out = run_steps(df, [Step("bad", lambda d, c: d.select("zz")), Step("none", lambda d, c: None), Step("up", upper), Step("off", lambda d, c: d.limit(0))], only=["bad", "none", "up"])
    rows = {r["t"]: (r["x"], r["_error"]) for r in out.df.collect()}
    assert rows["A"] == (1.0, None) and rows["b"][0] is None and "ZeroDivisionError" in rows["b"][1]
    assert out.used == ["none", "up"] and len(out.errors) == 1 and out.errors[0].startswith("bad:")
    register_jsonpath_rows(spark)
    df = spark.createDataFrame([('{"a":[{"p":1},{"p":"x"}]}', "$..p"), ("bad", "$")], "j string, e string")
    df.createOrReplaceTempView("j")
    got = spark.sql("SELECT pos, value FROM j, LATERAL jsonpath_rows(j.j, j.e)").collect()
    assert [(r["pos"], r["value"]) for r in got] == [(0, "1"), (1, "x")]
    assert F is not None


def test_named_groups_are_regexes(spark):
    d = spark.createDataFrame([("1", "http://h/api/a", 1.0), ("2", "http://h/b", 2.0)], "id string, url string, timestamp double")
    assert [r["id"] for r in C.filter_captures(d, "/(?P<x>api)/").collect()] == ["1"]
    assert [r["id"] for r in C.filter_captures(d, "(?P<x>t)(?P=x)p").collect()] in (["1", "2"], ["2", "1"])
