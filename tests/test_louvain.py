"""Louvain and merging over tables against one node after another."""

import random

import numpy as np
import pandas as pd
import pytest

from seamline.operators import cluster, louvain


def modularity(i, j, v, part, resolution=1.0):
    two_m, total, inside = 2 * v.sum(), {}, 0.0
    for a, b, w in zip(i.tolist(), j.tolist(), v.tolist()):
        for n in (a, b):
            total[part[n]] = total.get(part[n], 0) + w
        inside += 2 * w * (part[a] == part[b])
    return inside / two_m - resolution * sum((t / two_m) ** 2 for t in total.values())


def planted(n, groups, seed, degree=5, share=0.75):
    rng = np.random.default_rng(seed)
    of = rng.integers(0, groups, n)
    members = [np.flatnonzero(of == g) for g in range(groups)]
    i = rng.integers(0, n, n * degree)
    j = np.array([rng.choice(members[of[a]]) if rng.random() < share else rng.integers(0, n) for a in i])
    keep = i != j
    return i[keep], j[keep], rng.integers(1, 4, keep.sum()).astype(float)


def test_as_good_as_one_task(spark):
    """A graph and a hub through tables from the first level on, at two resolutions together."""
    i, j, v = planted(1200, 12, 3)
    hub = np.arange(1, 700)
    i, j, v = np.concatenate([i, np.zeros(len(hub), i.dtype)]), np.concatenate([j, hub]), np.concatenate([v, np.full(len(hub), 0.2)])
    df = spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "v": v})).repartition(5)
    got = cluster.swept(df, [1.0, 2.0], light=3000).collect()
    for r in (1.0, 2.0):
        part = {x["n"]: x["cluster"] for x in got if x["resolution"] == r}
        assert set(part) == {*i.tolist(), *j.tolist()} and all(part[c] == c and c <= n for n, c in part.items())
        assert modularity(i, j, v, part, r) >= 0.99 * modularity(i, j, v, louvain.local(i, j, v, r), r)


def test_nothing_to_join(spark):
    """Pairs far from each other, links of a node with itself, no links at all."""
    links = spark.createDataFrame([(0, 2 * k, 2 * k + 1, 1.0) for k in range(40)] + [(0, 5, 5, 1.0), (0, 100, 100, 2.0), (0, 8, 9, -1.0)], "p int, i long, j long, v double")
    for light in (1000, 10):
        got = {r["n"]: r["cluster"] for r in louvain.louvain(links, {0: 1.0}, light=light).collect()}
        assert got == {**{n: n - n % 2 for n in range(80)}, 100: 100}
    assert louvain.louvain(links.limit(0), {0: 1.0}).count() == 0


def test_names_and_grids(spark, rows):
    links = spark.createDataFrame([(g, a, b, w) for g in ("x", "y") for a, b, w in [("a", "b", 3.0), ("b", "c", 3.0), ("a", "c", 3.0), ("c", "d", 0.1), ("d", "e", 3.0), ("e", "f", 3.0), ("d", "f", 3.0)]] + [("z", "a", "b", 1.0)], "g string, i string, j string, v double")
    want = rows(cluster.swept(links, [0.5, 1.0], by=("g",)), "g", "resolution", "n", "cluster")
    assert rows(cluster.swept(links, [0.5, 1.0], by=("g",), light=3), "g", "resolution", "n", "cluster") == want and len(want) == 2 * 14


@pytest.mark.parametrize("light", [0, 12])
def test_merging_over_tables_equals_one_after_another(spark, light):
    """50 random graphs at once: every node of a small cluster ends where it ends in order."""
    rng, links, parts, want = random.Random(light), [], [], {}
    for p in range(50):
        n = rng.randint(4, 14)
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(2, 2 * n))})
        weights = [float(rng.randint(1, 3)) for _ in pairs]
        part = {x: rng.randrange(n) % rng.randint(2, n) for x in range(n)}
        first = {c: min(x for x in part if part[x] == c) for c in part.values()}
        part = {x: first[c] for x, c in part.items()}
        merged = cluster.merge_small(part, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), np.array(weights), 3)
        want |= {(p, x): c for x, c in merged.items()}
        links += [(p, a, b, w) for (a, b), w in zip(pairs, weights)]
        parts += [(p, x, c) for x, c in part.items()]
    got = cluster.merge_tables(spark.createDataFrame(parts, "p int, n long, cluster long"), spark.createDataFrame(links, "p int, i long, j long, v double"), 3, light).collect()
    assert {(r["p"], r["n"]): r["cluster"] for r in got} == want and len(got) == len(want)


def test_small_components_need_no_rounds(spark, monkeypatch):
    """Many small components of a large graph are clustered a part at a time, as all of them are by one task; one large component beside them still goes through tables."""
    rng = random.Random(4)
    links = [(f"c{c:03}-{a}", f"c{c:03}-{b}", float(rng.randint(1, 3))) for c in range(60) for a in range(6) for b in range(a) if rng.random() < 0.7]
    df = spark.createDataFrame([(0, *x) for x in links], "p int, i string, j string, v double")
    want = louvain.local(*(np.array(c) for c in zip(*sorted((min(a, b), max(a, b), w) for a, b, w in links))), 1.0)
    rounds = []
    run = louvain._Level.run
    monkeypatch.setattr(louvain._Level, "run", lambda self, *a: rounds.append(self.name) or run(self, *a))
    got = {r["n"]: r["cluster"] for r in louvain.louvain(df, {0: 1.0}, light=40).collect()}
    assert got == want and not rounds
    chain = [(f"z{a:03}", f"z{a + 1:03}", 1.0) for a in range(80)]
    more = louvain.louvain(df.union(spark.createDataFrame([(0, *x) for x in chain], df.schema)), {0: 1.0}, light=40, rounds=4, polish=2).collect()
    assert rounds and len(more) == len(want) + 81 and len({r["n"] for r in more}) == len(more)
    assert all(r["cluster"][0] == r["n"][0] for r in more)
