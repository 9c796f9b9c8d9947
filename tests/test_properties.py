"""Properties that hold for any input."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from seamline.operators import cluster, components, edl, metrics, pairs
from seamline.workspace import Workspace


def test_metrics_ignore_names_and_order(spark):
    rng = random.Random(1)
    for _ in range(5):
        rows = [(i, rng.randint(0, 4), rng.randint(0, 3)) for i in range(60)]
        df = spark.createDataFrame(rows, "n int, p int, t int")
        pred, truth = df.selectExpr("n", "p as cluster"), df.selectExpr("n", "t as cluster")
        turned = df.selectExpr("n", "(p * 3 + 1) % 5 as cluster")
        assert tuple(metrics.bcubed(pred, truth).first()) == pytest.approx(tuple(metrics.bcubed(turned, truth).first()))
        assert metrics.bcubed(pred, pred).first()["f1"] == 1 and metrics.pairwise_f1(truth, truth).first()["f1"] == 1
        same = [(a[1] == b[1], a[2] == b[2]) for i, a in enumerate(rows) for b in rows[:i]]
        tp, pp, tt = sum(x and y for x, y in same), sum(x for x, _ in same), sum(y for _, y in same)
        got = metrics.pairwise_f1(pred, truth).first()
        assert abs(got["precision"] - tp / pp) < 1e-12 and abs(got["recall"] - tp / tt) < 1e-12


def test_jaccard_equals_sets(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 12), rng.choice("abcdef")) for _ in range(60)]
    got = {(r["i"], r["j"]): r["v"] for r in pairs.jaccard(spark.createDataFrame(rows, "g int, n string").distinct()).collect()}
    have = {n: {g for g, m in rows if m == n} for n in "abcdef"}
    want = {(i, j): len(have[i] & have[j]) / len(have[i] | have[j]) for i in have for j in have if i < j and have[i] & have[j]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and all(0 <= v <= 1 for v in got.values())


def modularity(part, edges, resolution=1.0):
    m = sum(w for *_, w in edges)
    inside, degree = {}, {}
    for a, b, w in edges:
        degree[part[a]] = degree.get(part[a], 0) + w
        degree[part[b]] = degree.get(part[b], 0) + w
        if part[a] == part[b]:
            inside[part[a]] = inside.get(part[a], 0) + w
    return sum(inside.get(c, 0) / m - resolution * (d / (2 * m)) ** 2 for c, d in degree.items())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15), st.floats(0.1, 5)), min_size=1, max_size=60))
def test_louvain_never_worse_than_single_nodes(rows):
    edges = {(min(a, b), max(a, b)): w for a, b, w in rows if a != b}
    if not edges:
        return
    flat = [(a, b, w) for (a, b), w in sorted(edges.items())]
    i, j, v = (np.array(x) for x in zip(*flat))
    part = cluster.louvain(i, j, v)
    assert part == cluster.louvain(i, j, v)
    assert modularity(part, flat) >= modularity({n: n for n in part}, flat) - 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=80))
def test_forest_joins_the_same_nodes(rows):
    a, b = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 2
    x, y = components.forest(a, b)
    label = {int(p): int(q) for p, q in zip(x, y)}
    want = union(rows)
    assert label == {n: m for n, m in want.items() if n != m}


def union(rows):
    parent = {}

    def find(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for p, q in rows:
        p, q = find(p), find(q)
        parent[max(p, q)] = min(p, q)
    return {n: find(n) for n in list(parent)}


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(9)
    rows = [(k, k + 1) for k in range(100, 400)] + [(1000, k) for k in range(1001, 1400)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(150)] + [(5, 5), (None, 7)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(rows, "a long, b long").repartition(5)).collect()}
    want = union([r for r in rows if None not in r])
    assert got == {n: m for n, m in want.items() if n != m}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_look_at_all_links_once(spark, monkeypatch):
    """Of a graph with many links a node, all tables after the links together have fewer rows than the links, as no round goes over all of them."""
    kept, keep = {}, Workspace.keep
    monkeypatch.setattr(components, "LIGHT", 1000)
    monkeypatch.setattr(Workspace, "keep", lambda self, df, name: kept.setdefault(name, keep(self, df, name)))
    monkeypatch.setattr(Workspace, "drop", lambda self, *names: None)
    links = spark.range(400_000).selectExpr("pmod(xxhash64(id), 5000) + 20000 * pmod(id, 2) as a", "10000 + pmod(xxhash64(id, 1), 5000) + 20000 * pmod(id, 2) as b")
    got = {r["node"]: r["label"] for r in components.connected_components(links).collect()}
    assert got == {n: m for n, m in union(links.collect()).items() if n != m}
    sizes = [t.count() for name, t in kept.items()]
    assert max(sizes) == 400_000 and sum(sizes) < 800_000


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    net = edl.Network(4, sizes=(5, 3, 2))
    x, target = rng.normal(size=(6, 4)), np.eye(2)[rng.integers(0, 2, 6)]
    grads = edl._gradients(net, x, target, 0.1)
    for p, g in zip([*net.w, *net.b], grads):
        at = tuple(rng.integers(0, s) for s in p.shape)
        p[at] += 1e-6
        up = edl.loss(net, x, target, 0.1)
        p[at] -= 2e-6
        down = edl.loss(net, x, target, 0.1)
        p[at] += 1e-6
        assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_training_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    y = (x[:, 0] > 0).astype(int)
    net = edl.train(x, y, epochs=200, rate=5e-3, sizes=(16, 8, 2))
    assert (net.forward(x)[1].argmax(axis=1) == y).mean() > 0.95
    far, near = x[np.abs(x[:, 0]) > 1], x[np.abs(x[:, 0]) < 0.1]
    assert net.uncertainty(far).mean() < net.uncertainty(near).mean()
