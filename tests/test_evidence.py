"""Operators on evidence that no SQL covers: streams of traces, methods and their calls, networks, reports, sweeps."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import math, text
from seamline.operators import cluster, code, edl, metrics, report, spans
from seamline.streaming import traces

JAVA = """package a.b;
import a.c.Helper;
/* class Not { void no() { } } */
public class Shop extends Base {
  public <T> List<Map<String, T>> items(int n) { // open {
    if (n > 0) { return helper(n); }
    return null;
  }
  private List helper(int n) { return Other.load(n); }
  public Shop() { }
  public static void main(String[] args) { items(1); }
  public void items(String s) throws IOException { }
}
"""


def test_stream_of_traces(spark, tmp_path):
    def write(name, ids):
        spans_ = [{"traceId": "t", "spanId": i, "name": "x", "startTimeUnixNano": "1000", "endTimeUnixNano": "2000"} for i in ids]
        envelope = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}]}, "scopeSpans": [{"spans": spans_}]}]}
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(json.dumps(envelope) + "\n")

    run = lambda: traces.write_stream(traces.stream_spans(spark, str(tmp_path / "in"), "shop"), str(tmp_path / "out"), str(tmp_path / "state"), ("service",), until_done=True).awaitTermination(60)
    write("a.json", ["1", "2"])
    assert run()
    write("b.json", ["3"])
    assert run()  # goes on where it stopped: nothing comes twice
    assert sorted(r["span_id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["1", "2", "3"]


def test_methods_and_calls(spark):
    other = "package a.b;\nclass Other { static List load(int n) { return items(n); } int items(int x) { return x; } }"
    files = spark.createDataFrame([("s", JAVA), ("o", other), ("e", None)], "path string, text string")
    assert [r["name"] for r in code.public_methods(files).where("path = 's'").orderBy("k").collect()] == ["items"]
    found = code.methods(files).collect()
    got = {(r["fqcn"], r["name"], r["first"], r["last"]) for r in found}
    assert {("a.b.Shop", "items", 5, 8), ("a.b.Shop", "helper", 9, 9), ("a.b.Shop", "items", 12, 12), ("a.b.Other", "load", 2, 2)} <= got
    calls = {(r["source"], r["target"]) for r in code.call_edges(spark.createDataFrame(found)).collect()}
    assert calls == {("a.b.Shop.items", "a.b.Shop.helper"), ("a.b.Shop.helper", "a.b.Other.load"), ("a.b.Other.load", "a.b.Other.items"), ("a.b.Shop.main", "a.b.Shop.items")}


def test_network_is_kept_and_has_hard_negatives(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    y = (x[:, 0] > 0).astype(int)
    net = edl.train(x, y, epochs=5, sizes=(8, 4, 2), hard=0.5)
    edl.save(spark, net, str(tmp_path / "net"))
    again = edl.load(spark, str(tmp_path / "net"))
    assert np.allclose(net.uncertainty(x), again.uncertainty(x))
    # gradients of the weighted loss under dropout, against differences
    small, target = edl.Network(5, sizes=(6, 2)), np.eye(2)[y]
    mask, share = (rng.random((60, 6)) > 0.2) / 0.8, rng.random(60)

    def value():
        alpha = small.forward(x, mask)[1]
        s = alpha.sum(axis=1, keepdims=True)
        p, misled = alpha / s, target + (1 - target) * alpha
        each = ((target - p) ** 2).sum(axis=1) + (p * (1 - p) / (s + 1)).sum(axis=1) + 0.3 * edl.kl_to_uniform(misled)
        return float((share * each).sum())

    grad = edl._gradients(small, x, target, 0.3, share, mask)[0]
    for at in ((0, 0), (3, 5), (4, 2)):
        small.w[0][at] += 1e-6
        up = value()
        small.w[0][at] -= 2e-6
        down = value()
        small.w[0][at] += 1e-6
        assert grad[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)


def test_training_takes_all_pairs(spark):
    """More pairs than a block holds: each counts, whatever tasks they lie in."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 4))
    x[:, 3] = 7.0  # a component without any deviation
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    rows = [(f"a{k % 30}", f"b{k // 30}", x[k].tolist(), int(y[k])) for k in range(900)]
    pairs = spark.createDataFrame(rows, "i string, j string, x array<double>, y int")
    how = {"epochs": 12, "rate": 2e-2, "batch": 64, "sizes": (16, 8, 2)}
    net = edl.train_all(pairs, block=200, **how)
    assert np.allclose(net.mean, x.mean(axis=0), atol=1e-12) and np.allclose(net.sd, np.append(x[:, :3].std(axis=0), 1.0))  # of all pairs
    assert (net.forward(x)[1].argmax(axis=1) == y).mean() > 0.95
    again = edl.train_all(pairs.repartition(7), block=200, **how)
    assert all(np.array_equal(a, b) for a, b in zip([*net.w, *net.b], [*again.w, *again.b]))
    few = {"epochs": 1, "rate": 5e-3, "sizes": (16, 8, 2)}
    base = edl.train_all(pairs, block=200, **few)
    for k in range(0, 900, 450):  # any pair's label moves the network
        other = edl.train_all(spark.createDataFrame([(*r[:3], 1 - r[3]) if n == k else r for n, r in enumerate(rows)], pairs.schema), block=200, **few)
        assert any(not np.array_equal(a, b) for a, b in zip(base.w, other.w))
    # all in one block: one after another, as without tables
    whole, plain = edl.train_all(pairs, **few), [r.x for r in pairs.orderBy(F.xxhash64("i", "j", F.lit(42)), "i", "j").collect()]
    assert np.allclose(whole.mean, np.mean(plain, axis=0)) and edl.train_all(pairs.where("false"), **few).w[0].shape == (1, 16)


def test_reports_are_written(spark, tmp_path):
    part = spark.createDataFrame([("b", 1), ("a", 0)], "n string, cluster int")
    report.write_partition(part, str(tmp_path / "p"))
    assert sorted((r["n"], r["cluster"]) for r in spark.read.json(str(tmp_path / "p")).collect()) == [("a", 0), ("b", 1)]
    report.write_csv(part, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    report.write_meta(metrics.k_report(part, part), str(tmp_path / "m"), rate=0.2, system="shop")
    assert spark.read.json(str(tmp_path / "m")).first().asDict() == {"k": 2, "gt_k": 2, "k_diff": 0, "k_gap": 0, "collapsed": False, "rate": 0.2, "system": "shop"}
    edges = spark.createDataFrame([("a", "b", 0.5)], "i string, j string, v double")
    report.append_edges(edges, str(tmp_path / "e"), cap=0.1)
    report.append_edges(edges, str(tmp_path / "e"), cap=0.2)
    assert sorted(r["cap"] for r in spark.read.json(str(tmp_path / "e")).collect()) == [0.1, 0.2]


def test_master_table_is_refused(spark):
    rows = spark.createDataFrame([("shop", "ratio,density"), ("plants", "ratio")], "system string, reasons string").withColumn("status", F.lit("FAIL"))
    with pytest.raises(ValueError, match="shop: ratio,density"):
        report.master_table(rows)
    assert [r["system"] for r in report.master_table(rows.where("system = 'plants'")).collect()] == ["plants"]
    assert (report.least_cells("plants", 10), report.least_cells("acmeair", 200), report.least_cells("x", 10)) == (50, 796, 200)


def test_sweep_without_a_solution(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 0.1)], "i string, j string, v double")
    got = cluster.chosen_partition(edges, 2, 2, [0.5, 1.0], 2).collect()
    assert {frozenset(r["n"] for r in got if r["cluster"] == c) for c in {r["cluster"] for r in got}} == {frozenset("abc"), frozenset("def")}
    assert cluster.chosen_partition(edges, 50, 60, [1.0]).count() == 0
    small = edges.where("i in ('a', 'b', 'c') and j <> 'f' and j <> 'e'").union(spark.createDataFrame([("d", "e", 1.0)], edges.schema))
    assert cluster.chosen_partition(small, 2, 2, [1.0]).count() == 5
    assert cluster.chosen_partition(small, 2, 2, [1.0], 3).count() == 0  # merging leaves one cluster, out of the range
    assert len(cluster.resolutions()) == 158


def test_prompt_and_answers(spark):
    services = spark.createDataFrame([("s1", ["a", "b"]), ("s0", ["b", "c"])], "service string, classes array<string>")
    assert sorted(map(tuple, code.inverted(services).collect())) == [("a", "s1"), ("b", "s0"), ("c", "s0")]
    packages = spark.createDataFrame([("p", 2, ["A", "B"])], "pkg string, n long, members array<string>")
    words = spark.createDataFrame([("p.A", ["buy", "cart"])], "n string, keywords array<string>")
    got = code.assembled_prompt("shop", packages, words, 2, 4).first()[0]
    assert "2 to 4" in got and "- p (2): A, B" in got and "- p.A: buy, cart" in got


def test_scores_of_pairs(spark):
    rows = spark.createDataFrame([(1.0, 3.0), (None, 2.0), (2.0, None), (2.0, 2.0), (float("nan"), 1.0), (-1.0, 9.0)], "b double, n double")
    got = [(tuple(r[0]), r[1]) for r in rows.select(math.pair_scores(F.col("b"), F.col("n")), F.round(math.relative_gain(F.col("b"), F.col("n")), 6)).collect()]
    assert got == [((0.0, 1.0), 1.0), ((0.5, 0.5), 0.75), ((0.5, 0.5), 0.0), ((0.5, 0.5), 0.5), ((0.5, 0.5), 0.75), ((0.0, 1.0), 1.0)]


def test_camel_and_first_class(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.camel_parts(F.lit("PingServlet31AsyncREAD_x"))) == ["ping", "servlet", "31", "async", "x"]
    assert one(text.camel_text(F.lit("HTTPServer2go-x_y"))) == "HTTP Server go x y"
    found = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "id long, node string")
    assert sorted(map(tuple, spans.first_class(found).collect())) == [(1, "a"), (2, "c")]


def test_roots_and_outlines(spark):
    files = spark.createDataFrame([("/src/a/b/Shop.java", JAVA), ("/src/a/b/O.java", "package a.b;\nclass O { }"), ("/x/P.java", "package q;\nclass P { }"), ("/y/Q.java", "class Q { }")], "path string, text string")
    assert sorted(map(tuple, code.source_roots(files).collect())) == [("/src", 2), ("/x", 1), ("/y", 1)]
    got = {r["path"]: json.loads(r["outline"]) for r in code.outline(files).collect()}
    assert got["/src/a/b/Shop.java"] == {"fqcn": "a.b.Shop", "kind": "class", "bases": ["Base"], "imports": ["a.c.Helper"], "methods": ["items"]}
    assert len(got) == 4 and got["/y/Q.java"]["methods"] == []


def test_archive(spark, tmp_path):
    from seamline.sources import maps

    (tmp_path / "t.json").write_text("x")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part").write_text("y")
    paths = [str(tmp_path / n) for n in ("t.json", "d", "none")]
    assert len(maps.archive(spark, paths, str(tmp_path / "run"), empty=True)) == 2 and maps.archive(spark, paths, str(tmp_path / "run")) == []
    assert (tmp_path / "run/t.json").read_text() == "x" and (tmp_path / "run/d/part").read_text() == "y" and (tmp_path / "t.json").read_text() == "" and (tmp_path / "d/part").read_text() == "y"
