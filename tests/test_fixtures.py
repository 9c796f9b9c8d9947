"""Hand-computed cases of the engine's operators."""

import math

import pytest
from pyspark.sql import functions as F

from seamline.functions import math as fm
from seamline.functions import text
from seamline.operators import cluster, fusion, metrics, normalize, pairs, report, sampling, sessions, spans, structure, terms


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def events(spark, times, group="g"):
    return spark.createDataFrame([(group, i, t, "n") for i, t in enumerate(times)], "g string, seq long, t long, n string")


@pytest.mark.parametrize("times,cap,want", [
    ([0, 3000, 5001, 9000, 20000], 5000, [0, 0, 1, 1, 2]), ([-1, 0, None, 6000, -1, 6001], 5000, [0, 0, 0, 1, 1, 1]), ([-1, -1], 5000, [0, 0]), ([0, 99999], 0, [0, 0]), ([], 5000, []),
])
def test_anchored_sessions(spark, times, cap, want):
    got = sessions.anchored_sessions(events(spark, times), cap).orderBy("seq").collect()
    assert [r["session"] for r in got] == want


def test_sessions_of_groups_stay_apart(spark):
    both = events(spark, [0, 6000], "a").union(events(spark, [100, 200], "b"))
    got = {(r["g"], r["seq"]): r["session"] for r in sessions.anchored_sessions(both, 5000).collect()}
    assert got == {("a", 0): 0, ("a", 1): 1, ("b", 0): 0, ("b", 1): 0}


def test_count_windows(spark):
    got = {}
    for r in sessions.count_windows(spark.createDataFrame([("g", i, str(i)) for i in range(7)], "g string, seq long, n string"), 3, 2).collect():
        got.setdefault(r["w"], []).append(r["seq"])
    assert {w: sorted(s) for w, s in got.items()} == {0: [0, 1, 2], 1: [2, 3, 4], 2: [4, 5, 6]}
    assert sessions.count_windows(spark.createDataFrame([("g", 0, "a"), ("g", 1, "b")], "g string, seq long, n string"), 3, 2).count() == 0


def test_jaccard(spark):
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "c")], "g int, n string")
    got = {(r["i"], r["j"]): r["v"] for r in pairs.jaccard(sets).collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): pytest.approx(1 / 3), ("b", "c"): pytest.approx(1 / 3)}


def test_dense_cosine_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 4))
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "n long, e array<double>")
    got = {(r["i"], r["j"]): r["v"] for r in pairs.dense_cosine(df, 8).collect()}
    assert len(got) == 50 * 49 // 2
    for (i, j), s in got.items():
        z = np.linalg.norm(v[i]) * np.linalg.norm(v[j])
        assert i < j and s == pytest.approx(v[i] @ v[j] / z if z else 0)


def test_labels_and_names(spark):
    label = lambda s: text.label_key(F.lit(s))
    assert one(spark, label("REST - Login (F2)"), label("Home / Promo Page"), label("J1_User_Browse")) == ("restloginf2", "homepromopage", "j1userbrowse")
    assert one(spark, text.camel_words(F.lit("FlightServiceImpl2HTTPServer_x")))[0] == ["flight", "service", "impl", "http", "server", "x"]
    assert one(spark, text.class_key(F.lit(" a.B.java ")), text.class_key(F.lit("007")), text.owner(F.lit("a.B.m")), text.leaf_package(F.lit("a.b.C"))) == ("a.B", "7", "a.B", "b")
    assert one(spark, text.signature_class(F.lit("void com.x.Order.place(int)"), "com.x"), text.plain_name(F.lit("a.List<String> []"))) == ("com.x.Order", "a.List")


def test_queries(spark):
    action = lambda s: text.query_action(F.lit(s))
    assert one(spark, action("viewItem=&itemId=EST-1"), action('{"viewItem":"","itemId":"1"}')) == ("viewItem", "viewItem")
    token = lambda s: text.action_token(F.lit(s))
    assert one(spark, token("actionlogin&uid=1"), token("action=marketSummary"), token("x=1")) == ("login", "marketSummary", None)
    assert one(spark, text.query_params(F.lit("A=1&b&a=2&c=x=y")))[0] == {"b": "", "a": "2", "c": "x=y"}
    assert one(spark, text.trace_id(F.lit("00-" + "a" * 32 + "-b-01")), text.trace_id(F.lit("00-12-b-01"))) == ("a" * 32, None)


def test_metrics(spark):
    cluster_ = lambda rows: spark.createDataFrame(rows, "n string, cluster int")
    truth, pred = cluster_([("a", 0), ("b", 0), ("c", 1), ("d", 1)]), cluster_([("a", 0), ("b", 0), ("c", 0), ("d", 1)])
    assert tuple(metrics.pairwise_f1(pred, truth).first()) == pytest.approx((1 / 3, 1 / 2, 0.4))
    assert tuple(metrics.bcubed(pred, truth).first()) == pytest.approx((2 / 3, 3 / 4, 12 / 17))
    assert tuple(metrics.mojo(pred, truth).first()) == (1, 4, 75.0)
    deps = spark.createDataFrame([("a", "b", 2), ("a", "d", 1), ("c", "d", 3)], "source string, target string, w int")
    assert tuple(metrics.coupling(deps, pred).first()) == pytest.approx((4, 2 / 3))
    assert metrics.ned(pred).first()["ned"] == pytest.approx(0.5)
    assert metrics.structural_modularity(deps, pred).first()["sm"] == pytest.approx(1 / 6 - 2 / 3)
    assert tuple(metrics.structural_modularity(deps, cluster_([("a", 0), ("b", 0), ("d", 0), ("c", 0)])).first()) == (0, 0, 0)
    none = cluster_([])
    assert tuple(metrics.pairwise_f1(none, none).first()) == (0, 0, 0) and tuple(metrics.bcubed(none, none).first()) == (0, 0, 0)
    assert metrics.cluster_sizes(pred).first().asDict() == {"k": 2, "smallest": 1, "p25": 1, "median": 2, "p75": 2, "largest": 3, "singletons": 1}


def test_universe_keeps_names(spark):
    """Nodes keep their own names when others are left out before clustering."""
    truth = spark.createDataFrame([("x", -1), ("y", 0), ("z", 1)], "n string, label int")
    sim = spark.createDataFrame([("x", "y", 0.9), ("y", "z", 0.8)], "i string, j string, v double")
    known = truth.where("label >= 0")
    left = sim.join(known.select(F.col("n").alias("i")), "i", "left_semi").join(known.select(F.col("n").alias("j")), "j", "left_semi").select("i", "j", "v")
    assert {r["n"] for r in cluster.swept(left, [1.0]).collect()} == {"y", "z"}


def test_package_distance_and_hubs(spark):
    d = lambda a, b: fm.package_distance(F.lit(a), F.lit(b))
    assert one(spark, d("a.b.c", "a.b.d.e"), d("a.b", "a.b"), d("x", "y.z")) == (3, 0, 3)
    edges = spark.createDataFrame([(f"s{k}", "hub") for k in range(9)] + [(f"s{k}", "mid") for k in range(4)], "source string, target string")
    idf = {r["n"]: (r["idf"], r["is_hub"]) for r in structure.hub_weights(edges, 9).collect()}
    assert idf["hub"] == (pytest.approx(0), True) and idf["mid"] == (pytest.approx(math.log(2) / math.log(10)), False)


def test_damping(spark):
    s, u = F.lit(0.8), F.lit(0.5)
    got = one(spark, fm.damp_exp(s, u, 2), fm.damp_gate(s, u, F.lit(0.5), 2), fm.damp_sigmoid(s, u, 15, F.lit(0.5)))
    assert got == pytest.approx((0.294304, 0.2, 0.4), abs=1e-6)


def test_threshold(spark):
    sim = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 4.0), ("a", "d", 10.0), ("b", "d", 0.0)], "i string, j string, v double")
    assert fusion.edge_threshold(sim, 0.7, 0.02).first()["tau"] == 0.02
    assert fusion.edge_threshold(sim, 0.7, 9).first()["tau"] == pytest.approx(float(__import__("numpy").percentile([1, 1, 2, 2, 4, 4, 10, 10], 70)))


def test_full_median_counts_every_cell(spark):
    import numpy as np

    u = spark.createDataFrame([(0, 1, 0.4), (0, 2, 0.2), (1, 2, 0.9)], "i int, j int, v double")
    full = np.zeros((3, 3))
    for i, j, v in ((0, 1, 0.4), (0, 2, 0.2), (1, 2, 0.9)):
        full[i, j] = full[j, i] = v
    assert fusion.median_full(u, 3).first()["m"] == pytest.approx(np.median(full))


def test_interval_join(spark):
    windows = spark.createDataFrame([("k", 100, 200)], "k string, ws long, wt long")
    spans_ = spark.createDataFrame([("k", 95, 150)], "k string, s long, t long")
    count = lambda slack, inside, width: pairs.interval_join(spans_, windows, ["k"], slack, inside, width).count()
    for width in (7, 60, 1000):
        assert (count(0, True, width), count(5, True, width), count(0, False, width)) == (0, 1, 1)


def test_degenerate_matrices(spark):
    sim = lambda rows: spark.createDataFrame(rows, "i string, j string, v double")
    assert [r["v"] for r in normalize.minmax(sim([("a", "b", 0.5), ("a", "c", 0.5)])).collect()] == [0, 0]
    for f in (normalize.minmax, normalize.quantile_ranks, normalize.robust):
        assert f(sim([])).count() == 0
    assert [r["v"] for r in normalize.quantile_ranks(sim([("a", "b", 0.5)])).collect()] == [0]
    assert pairs.jaccard(spark.createDataFrame([], "g int, n string")).count() == 0


def test_refiner_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    s = rng.random((6, 6))
    s = (s + s.T) / 2
    np.fill_diagonal(s, 1)
    z = np.ones((6, 6))
    for i in range(6):
        off = [j for j in range(6) if j != i]
        z[i, off] = 1 / (1 + np.exp(-(s[i, off] - s[i, off].mean()) / (s[i, off].std() + 1e-6)))
    m = (z - z.min()) / (z.max() - z.min())
    r = 0.5 * np.clip(m * (0.5 / m.mean()), 0, 1) + 0.5 * m
    want = (r + r.T) / 2
    df = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(6) for j in range(6)], "i int, j int, v double")
    got = normalize.refine(df).collect()
    assert len(got) == 15 and all(x["v"] == pytest.approx(want[x["i"], x["j"]]) for x in got)


def test_louvain_and_merging():
    import numpy as np

    a = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]
    i, j = (np.array(x) for x in zip(*a))
    part = cluster.louvain(i, j, np.ones(len(a)))
    assert [part[k] for k in range(6)] == [0, 0, 0, 3, 3, 3]
    assert cluster.merge_small({0: 0, 1: 0, 2: 0, 3: 3}, np.array([0, 2]), np.array([1, 3]), np.array([1.0, 2.0]), 3) == {0: 0, 1: 0, 2: 0, 3: 0}
    assert cluster.merge_small({0: 0, 1: 1}, np.array([], int), np.array([], int), np.array([]), 3) == {0: 0, 1: 1}  # nowhere to go


def test_exact_drop_counts(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("g"), "id")
    for rate in (0, 0.1, 0.5, 0.95, 1):
        assert sampling.drop_exact(df, "g", rate).select("g").distinct().count() == round((1 - rate) * 37)


def test_sampling_shuffle_keeps_values(spark):
    sim = spark.createDataFrame([(i, j, i + j / 100) for i in range(20) for j in range(i + 1, 20)], "i int, j int, v double")
    got = sampling.shuffled(sim).collect()
    assert sorted(r["v"] for r in got) == sorted(r["v"] for r in sim.collect()) and len({(r["i"], r["j"]) for r in got}) == 190


def test_rules(spark):
    values = spark.createDataFrame([(1, "url", "/Cart/View"), (2, "url", None), (3, "op", "cart")], "id int, field string, value string")
    rules = spark.createDataFrame([("url", "contains", "cart", "Cart"), ("url", "prefix", "/cart/v", "View"), ("op", "exact", "cart", "Cart")], "field string, kind string, pattern string, node string")
    assert sorted(map(tuple, spans.resolve(values, rules).collect())) == [(1, "Cart"), (1, "View"), (3, "Cart")]
    longest = spans.longest_rule(values, spark.createDataFrame([("/Cart", "a"), ("/Cart/V", "b")], "pattern string, node string"))
    assert [tuple(r) for r in longest.collect()] == [(1, "b")]


def test_reports(spark):
    m = spark.createDataFrame([("x", "old", 2.0), ("x", "new", 3.0), ("y", "old", 0.0), ("y", "new", 1.0)], "system string, method string, f1 double")
    got = {r["system"]: r["percent"] for r in report.improvements(m, "system", "method", "old", "new", {"f1": True}).collect()}
    assert got == {"x": 50.0, "y": None}
    assert "| x | 2.5000 |" in report.to_markdown(m.where("system = 'x'").groupBy("system").agg(F.avg("f1").alias("f1")))
    with pytest.raises(ValueError):
        report.to_markdown(m, rows=2)
    gate = report.gate(spark.createDataFrame([(5, 0.5, 2.0), (50, 0.5, None), (50, 0.5, 2.0)], "edges int, density double, ratio double"))
    assert sorted((r["edges"], r["status"], r["reasons"]) for r in gate.collect()) == [(5, "FAIL", "edges"), (50, "FAIL", "ratio"), (50, "PASS", "")]


def test_terms(spark):
    docs = spark.createDataFrame([(1, "Alpha beta beta"), (2, "beta gamma this"), (3, None)], "d int, text string")
    got = {r["word"]: r["df"] for r in terms.document_frequency(docs).collect()}
    assert got == {"alpha": 1, "beta": 2, "gamma": 1}
    assert {r["d"]: r["distilled"] for r in terms.distilled(docs, F.lit("N"), 1.5).collect()} == {1: "N N N alpha", 2: "N N N gamma", 3: "N N N"}
    assert {r["d"]: len(r["e"]) for r in terms.hashed_vectors(docs, 8).collect()} == {1: 8, 2: 8}
