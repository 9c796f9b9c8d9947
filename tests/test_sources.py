"""Readers on small files of each format."""

import json
import os

from seamline.sources import jtl, maps, otlp


def test_jtl_with_and_without_header(spark, tmp_path):
    row = '1000,12,T_Login,200,OK,th 1,text,true,"a, b",10,5,1,1,http://x/y,3,0,1'
    head = ",".join(jtl.COLUMNS[:17])
    for name, lines in (("a", [head, row, row.replace("1000", "x").replace("T_Login", "Flow")]), ("b", [row])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        got = jtl.read_jtl(spark, str(tmp_path / name)).collect()
        assert len(got) == len(lines) - (name == "a")
        assert (got[0]["timeStamp"], got[0]["label"], got[0]["failureMessage"], got[0]["threadIteration"]) == (1000, "T_Login", "a, b", None)
        assert jtl.transactions(jtl.read_jtl(spark, str(tmp_path / name))).count() == 1
    (tmp_path / "short").write_text("label,timeStamp\nx,5\n")
    got = jtl.read_jtl(spark, str(tmp_path / "short")).first()
    assert (got["label"], got["timeStamp"], got["URL"]) == ("x", 5, None)


def span(**more):
    return {"traceId": "t1", "spanId": "s1", "name": "GET /a", "kind": 2, "startTimeUnixNano": "5000000", "endTimeUnixNano": 9000000, "attributes": [{"key": "url.path", "value": {"stringValue": "/a"}}, {"key": "n", "value": {"intValue": "3"}}]} | more


def test_spans(spark, tmp_path):
    resource = {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}, {"key": "n", "value": {"intValue": "1"}}]}
    lines = [
        json.dumps({"resourceSpans": [{"resource": resource, "scopeSpans": [{"scope": {"name": "lib"}, "spans": [span(), span(endTimeUnixNano="1"), span(startTimeUnixNano=None)]}]}]}),
        json.dumps({"resourceSpans": [{"resource": resource, "instrumentationLibrarySpans": [{"instrumentationLibrary": {"name": "old"}, "spans": [span(spanId="s2", attributes=[{"key": "url.path", "value": {"stringValue": "/x.css"}}])]}]}]}),
        "not json", "", json.dumps({"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": [span(spanId="s3")]}]}]}),
    ]
    (tmp_path / "traces").write_text("\n".join(lines))
    got = {r["span_id"]: r for r in otlp.read_spans(spark, str(tmp_path / "traces"), "shop").collect()}
    assert set(got) == {"s1", "s2"}
    assert (got["s1"]["start_us"], got["s1"]["end_us"], got["s1"]["kind"], got["s1"]["scope"]) == (5000, 9000, 2, "lib") and got["s2"]["scope"] == "old"
    assert got["s1"]["attrs"] == {"service.name": "shop", "otel.scope.name": "lib", "url.path": "/a", "n": "3"}
    everything = otlp.read_spans(spark, str(tmp_path / "traces"))
    assert everything.count() == 3 and otlp.served(everything).count() == 2
    otlp.write_by_service(everything.where("service is not null"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).select("service").distinct().count() == 1


def test_logs(spark, tmp_path):
    record = {"traceId": "t", "severityText": "INFO", "body": {"stringValue": "hello"}, "attributes": [{"key": "k", "value": {"boolValue": True}}]}
    (tmp_path / "logs").write_text(json.dumps({"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"logRecords": [record]}]}]}) + "\nbroken")
    got = otlp.read_logs(spark, str(tmp_path / "logs")).collect()
    assert [(r["trace_id"], r["body"], r["attrs"]) for r in got] == [("t", "hello", {"k": "true"})]


def test_maps(spark, tmp_path):
    write = lambda name, x: (tmp_path / name).write_text(x if isinstance(x, str) else json.dumps(x)) and str(tmp_path / name)
    assert [tuple(r) for r in maps.read_order(spark, write("order", ["b", "a"])).collect()] == [("b", 0), ("a", 1)]
    assert sorted(map(tuple, maps.read_labels(spark, write("labels", {"a": 1, "s": ["b", "c"]})).collect())) == [("a", "1"), ("b", "s"), ("c", "s")]
    assert [tuple(r) for r in maps.read_dependencies(spark, write("deps", {"a": {"b": 2}})).collect()] == [("a", "b", 2.0)]
    assert [tuple(r) for r in maps.read_graph(spark, write("graph", {"nodes": ["a"], "edges": [{"source": "a", "target": "b"}]})).collect()] == [("a", "b")]
    for form in ('[{"x": 1}, {"x": 2}]', '{"x": 1}\n\n{"x": 2}\n', '{"x": 1} {"x": 2}', '{"x": 1}{\n "x":\n 2}\n', '{"x": 1, "s": "} {"}\n{"x": 2}', '[\n{"x": 1},\n{"x": 2}\n]\n', '{"x": 1}\nbroken {\n{"x": 2}'):
        assert sorted(r["x"] for r in maps.read_objects(spark, write("objects", form), "x int").collect()) == [1, 2]
    md = maps.read_markdown(spark, write("table.md", "# t\n\n| a | b |\n|---|---:|\n| 1 | x y |\n"))
    assert [r["cells"] for r in md.collect()] == [["a", "b"], ["1", "x y"]]
    got = maps.inventory(spark, str(tmp_path), "table.md").first()
    assert (got["bytes"], got["lines"]) == ((tmp_path / "table.md").stat().st_size, 5)
    assert [tuple(r) for r in maps.class_dim(spark.createDataFrame([("b",), ("B",), ("b",)], "fqcn string")).orderBy("node_id").collect()] == [(0, "B"), (1, "b")]


def test_values_and_single_spans(spark, tmp_path):
    """Lists and maps as attribute values, spans without an envelope, times in microseconds, and the way back."""
    listed = {"arrayValue": {"values": [{"stringValue": 'a"b'}, {"intValue": "2"}, {"arrayValue": {"values": [{"boolValue": True}]}}]}}
    keyed = {"kvlistValue": {"values": [{"key": "x", "value": {"stringValue": "y"}}, {"key": "z", "value": {"doubleValue": 1.5}}]}}
    lines = [
        span(spanId="a", attributes=[{"key": "l", "value": listed}, {"key": "m", "value": keyed}, {"key": "e", "value": {"arrayValue": {}}}]), span(spanId="b", attributes={"k": "v"}),
        {"trace_id": "t2", "span_id": "c", "operationName": "x", "startTimeUnixMicro": 7, "endTimeUnixMicro": "9", "traceId": "t2"}, {"traceId": "t", "spanId": "d"},
    ]
    (tmp_path / "flat").write_text("\n".join(map(json.dumps, lines)))
    got = {r["span_id"]: r for r in otlp.read_spans(spark, str(tmp_path / "flat")).collect()}
    assert set(got) == {"a", "b", "c"}
    attrs = got["a"]["attrs"]
    assert json.loads(attrs["l"]) == ['a"b', 2, [True]] and json.loads(attrs["m"]) == {"x": "y", "z": 1.5} and attrs["e"] == "[]"
    assert got["b"]["attrs"] == {"k": "v"} and (got["c"]["start_us"], got["c"]["end_us"], got["c"]["trace_id"]) == (7, 9, "t2")
    otlp.write_by_service(otlp.read_spans(spark, str(tmp_path / "flat")).na.fill({"service": "s"}), str(tmp_path / "out"))
    back = {r["span_id"]: r for r in otlp.read_spans(spark, str(tmp_path / "out/service=s")).collect()}
    assert set(back) == set(got) and json.loads(back["a"]["attrs"]["l"]) == json.loads(attrs["l"]) and back["c"]["start_us"] == 7


def test_positional_and_limited(spark, tmp_path):
    row = lambda t, label, url: ",".join([str(t), "1", label, *["x"] * 10, url])
    (tmp_path / "p").write_text("\n".join([row(30, "b", "/b"), row(10, "Flow 1", "/"), row(20, "a", "/a"), "40,1,c", row(5, "Transaction x", "/")]))
    assert [(r["t"], r["label"], r["url"]) for r in jtl.read_positional(spark, str(tmp_path / "p")).collect()] == [(20, "a", "/a"), (30, "b", "/b"), (40, "c", "")]
    (tmp_path / "h").write_text("label,timeStamp\n" + "\n".join(f"l{k},{k}" for k in range(9)))
    assert [r["label"] for r in jtl.read_jtl(spark, str(tmp_path / "h"), 3).collect()] == ["l0", "l1", "l2"]
    got = jtl.read_csv(spark, str(tmp_path / "h"))
    assert dict(got.dtypes) == {"label": "string", "timeStamp": "int"} and got.count() == 9


def test_paths_and_output(spark, tmp_path):
    for k, name in enumerate(("a_old.csv", "a_new.csv", "b_1.csv")):
        (tmp_path / name).write_text(f"mu,f1\n0.{k},{name}\n")
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    paths = [str(tmp_path / n) for n in ("none", "a_old.csv", "a_new.csv")]
    assert maps.first_existing(spark, paths) == paths[1] and maps.newest(spark, paths) == paths[2] and maps.first_existing(spark, paths[:1]) is None
    got = maps.read_latest(spark, str(tmp_path / "*.csv"), r"/([ab])_[^/]*\.csv$").collect()
    assert sorted((r["system"], r["f1"]) for r in got) == [("a", "a_new.csv"), ("b", "b_1.csv")]
    lines = spark.createDataFrame([(0, "F1: 0.5"), (1, "noise"), (2, "F1: 0.75"), (3, "K = 4")], "seq long, value string")
    assert tuple(maps.scraped(lines, {"f1": r"F1:\s*([0-9.]+)", "k": r"K = (\d+)", "q": "Q=(.)"}).first()) == (0.75, 4.0, None)
