"""Queries over whole tables against brute force."""

import os
from collections import Counter
from itertools import combinations

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from seamline.operators import cluster, components, edl, structure
from seamline.plans import evidence, queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data absent")


def read(name, *columns, sf=SF):
    t = pq.read_table(f"{sf}/{name}.parquet", columns=list(columns))
    return list(zip(*(t.column(c).to_pylist() for c in columns)))


def labels(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(near):
        todo = [] if n in out else [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return {x: n for x, n in out.items() if x != n}


def tables(spark, path, links):
    """Orders and their lines for links (customer, part)."""
    spark.createDataFrame([(i, c) for i, (c, _) in enumerate(links)], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(i, p, 1.0, 0.0) for i, (_, p) in enumerate(links)], "l_orderkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{path}/lineitem.parquet")


@pytest.mark.parametrize("light", [1 << 20, 0])  # 0: by stars to the end, as in large tables until few links are left
def test_components_of_all_links(spark, tmp_path, monkeypatch, light):
    monkeypatch.setattr(components, "LIGHT", light)
    got = {r["node"]: r["label"] for r in entry.queries()["connected_components"](spark, SF).collect()}
    orders = dict(read("orders", "o_orderkey", "o_custkey"))
    assert got == labels((orders[o], 10_000_000 + p) for o, p in read("lineitem", "l_orderkey", "l_partkey"))
    links = [(1, 1), (2, 1), (2, 2), (5, 7), (6, 7), (9, 9)]
    tables(spark, str(tmp_path), links)
    got = {r["node"]: r["label"] for r in entry.queries()["connected_components"](spark, str(tmp_path)).collect()}
    assert got == labels((c, 10_000_000 + p) for c, p in links) and len(set(got.values())) == 3


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_bridges_of_all_pairs(spark, sf):
    path = f"/root/testdata/{sf}"
    nation, by = dict(read("supplier", "s_suppkey", "s_nationkey", sf=path)), {}
    for p, k in read("lineitem", "l_partkey", "l_suppkey", sf=path):
        if k in nation:
            by.setdefault(p, set()).add(nation[k])
    want = Counter(pair for ns in by.values() for pair in combinations(sorted(ns), 2))
    assert {(r["i"], r["j"]): r["n"] for r in entry.queries()["entity_bridging"](spark, path).collect()} == want


def test_default_cap_of_bridges(spark):
    uses = spark.createDataFrame([(n, "x") for n in range(70)] + [(n, "y") for n in range(25)], "n long, entity string")
    got = {(r["i"], r["j"]): r["n"] for r in structure.bridges(uses).collect()}
    want = Counter(list(combinations(range(70), 2))[:2000]) + Counter(combinations(range(25), 2))
    assert got == want and sum(got.values()) == 2300


def test_uncertainty_of_all_pairs(spark, monkeypatch):
    """Brands that lack a type stay, and training has the operator's epochs."""
    asked, train = [], edl.train
    monkeypatch.setattr(edl, "train", lambda x, y, **settings: asked.append(settings) or train(x, y, **settings))
    got = {(r["i"], r["j"]) for r in entry.queries()["edl_infer"](spark, SF).collect()}
    want = set()
    for of in (plans.struct, plans.sem, plans.temp):
        want |= {(r["i"], r["j"]) for r in of(spark, SF).select("i", "j").collect()}
    assert got == want and len(want) > 1 and asked[0].get("epochs", 30) == 30


def test_runner_takes_all_partners(spark, monkeypatch):
    """Each setting's whole graph is clustered, however many partners a node has."""
    seen, swept = [], cluster.swept
    monkeypatch.setattr(cluster, "swept", lambda edges, *args, **settings: seen.append(edges) or swept(edges, *args, **settings))
    got = {r["setting"]: r for r in entry.queries()["table_runner"](spark, SF).collect()}
    pairs = lambda rows: {(r["setting"], r["i"], r["j"]) for r in rows}
    graphs = evidence.settings(spark, SF).collect()
    assert pairs(seen[0].collect()) == pairs(graphs) and set(got) == {r["setting"] for r in graphs}
    assert max(Counter((r["setting"], r["i"]) for r in graphs).values()) > 6
