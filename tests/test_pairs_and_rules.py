"""Groups of any size in pieces; rules as automata."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seamline.operators import pairs, spans


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_large_group_is_many_tasks(spark, many_tasks):
    sets = spark.range(1500).select(F.lit("hot").alias("g"), F.col("id").alias("n")).union(spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 1), ("c", 9)], "g string, n long"))
    met = pairs._meet(sets.withColumn("x", F.lit(1)), "g", block=64)
    tasks = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 1500 * 1499 // 2 + 2 and len(tasks) == 40 and max(tasks) < 3 * sum(tasks) / 40
    assert met.where("l.n >= r.n").count() == 0 and met.select("l.n", "r.n").toDF("i", "j").groupBy("i", "j").count().where("count > 1").collect() == [(1, 2, 3)]


@pytest.mark.parametrize("block", [4, 1024])
def test_pairs_by_blocks_equal_all_pairs(spark, block):
    rng = random.Random(block)
    groups = {g: rng.sample(range(60), rng.choice([1, 2, 5, 30])) for g in range(25)}
    rows = [(g, n) for g, ns in groups.items() for n in ns]
    want = Counter(p for ns in groups.values() for p in combinations(sorted(ns), 2))
    sets = spark.createDataFrame(rows, "g long, n long")
    assert {(r["i"], r["j"]): r["co"] for r in pairs.cooccurrence(sets, block).collect()} == want
    occ = Counter(n for _, n in rows)
    assert {(r["i"], r["j"]): r["v"] for r in pairs.jaccard(sets, block).collect()} == pytest.approx({(i, j): c / (occ[i] + occ[j] - c) for (i, j), c in want.items()})
    count = {(n, g): rng.randint(1, 9) for g, n in rows}
    norm = {n: sum(c * c for (m, _), c in count.items() if m == n) ** 0.5 for n in occ}
    dot = {p: sum(count[p[0], g] * count[p[1], g] for g, ns in groups.items() if {*p} <= {*ns}) / norm[p[0]] / norm[p[1]] for p in want}
    got = pairs.count_cosine(spark.createDataFrame([(n, g, c) for (n, g), c in count.items()], "n long, k long, c long"), block).collect()
    assert {(r["i"], r["j"]): r["v"] for r in got} == pytest.approx(dot)


@pytest.mark.parametrize("rule_bytes", [1 << 25, 700])
def test_automata_equal_every_rule_by_itself(spark, rule_bytes):
    rng = random.Random(rule_bytes)
    word = lambda n: "".join(rng.choice("aBé/") for _ in range(n))
    rules = [(rng.choice("xy"), rng.choice(["exact", "prefix", "contains", "longest"]), word(rng.randint(0, 4)), f"n{rng.randrange(30)}") for _ in range(120)] + [("x", "contains", None, "n1"), (None, "contains", "a", "n2"), ("x", "other", "a", "n3")]
    values = [(k, rng.choice("xyz"), word(rng.randint(0, 9))) for k in range(200)] + [(900, "x", None), (901, None, "a")]
    for fold in (True, False):
        low = lambda s: s.lower() if fold and s else s  # noqa: B023, E731
        want = set()
        for k, field, value in values:
            if value is None or field is None:
                continue
            own, v = [(r[1], low(r[2]), r[3]) for r in rules if r[0] == field and r[2]], low(value)
            longest = min(((-len(p), p) for kind, p, _ in own if kind == "longest" and p in v), default=(0, None))[1]
            want |= {(k, n) for kind, p, n in own if {"exact": v == p, "prefix": v.startswith(p), "contains": p in v, "longest": p == longest}.get(kind)}
            want |= {(k, r[3]) for r in rules if r[0] == field and r[1] == "exact" and r[2] == "" == v}
        got = spans.resolve(spark.createDataFrame(values, "id long, field string, value string"), spark.createDataFrame(rules, "field string, kind string, pattern string, node string"), fold, rule_bytes)
        assert {tuple(r) for r in got.collect()} == want
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_many_rules(spark):
    """Ten thousand rules by a hundred thousand values."""
    rules = spark.range(10_000).select(F.lit("f").alias("field"), F.when(F.col("id") % 2 == 0, "contains").otherwise("longest").alias("kind"), F.concat(F.lit("k"), "id", F.lit(".")).alias("pattern"), F.col("id").alias("node"))
    values = spark.range(100_000).select("id", F.lit("f").alias("field"), F.concat(F.lit("/a/k"), F.col("id") % 20_000, F.lit("./b/k3./")).alias("value"))
    got = spans.resolve(values, rules).groupBy(F.col("node") == 3).count().collect()
    # Each number is in five values, and k3. in all. Even rules are found beside it; of odd ones the longer come before it, and k1. of those as long.
    assert dict(map(tuple, got)) == {True: 50_000 + 25_000 + 5 * 4, False: 25_000 + 5 * 4995 + 5}


def test_traces_and_chains(spark):
    c = spark.createDataFrame([("w", "a", 9, 0), ("w", "b", 3, 1), ("w", "c", 3, 2), ("v", "d", 5, 0)], "w string, trace_id string, spans long, hits long")
    assert [tuple(r) for r in spans.best_trace(c).collect()] == [("w", "c", 3, 2)]
    rows = [("w", 1, 9, "s2", "a", "/y", "lib", "N", "f"), ("w", 1, 3, "s1", "b", "/x", "", "N", None), ("w", 0, 5, "s3", None, "/y", "lib2", None, "g"), ("w", 2, 2, "s4", "a", None, None, "N", "f")]
    got = spans.call_chains(spark.createDataFrame(rows, "w string, start long, end long, span_id string, service string, route string, scope string, namespace string, function string")).first()
    assert tuple(got) == ("w", 4, ["b", "a"], ["/y", "/x"], ["lib2", "lib"], ["N.f"], "/y|/x|lib2|lib")


def test_cosines_by_cells_and_tiles(spark, monkeypatch):
    """Vectors are dealt out SIDES times at most, not once for each 1024 of them; every pair is met once, whatever the tiles."""
    rng = np.random.default_rng(3)
    e = np.round(rng.normal(0, 1, (90, 5)), 2)
    e[7], e[50], e[60:64] = 0, e[3], e[9]
    label = [None if n == 11 else int(n % 4) - 1 for n in range(90)]
    df = spark.createDataFrame([(1000 - 7 * n, e[n].tolist(), label[n]) for n in range(90)], "n long, e array<float>, label long")
    u = e.astype(np.float32).astype(float)
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    v = (u @ u.T + 1) / 2
    all_pairs = [(1000 - 7 * b, 1000 - 7 * a, v[a, b], label[a], label[b]) for a in range(90) for b in range(a + 1, 90)]
    monkeypatch.setattr(pairs, "SIDES", 3)
    assert pairs._cells(df, 4).count() == 3 * 90
    monkeypatch.setattr(pairs, "SIDE", 8 * 5 * 18)
    assert pairs._cells(df, 4).count() == 5 * 90
    for block, tile in ((1024, 512), (4, 7), (30, 3)):
        monkeypatch.setattr(pairs, "TILE", tile)
        got = {(r["i"], r["j"]): r["v"] for r in pairs.dense_cosine(df, block).collect()}
        assert got == pytest.approx({(i, j): 2 * x - 1 for i, j, x, *_ in all_pairs})
        top = [(r["i"], r["j"], r["same"]) for r in pairs.cosine_top(df, 12, block).collect()]
        best = sorted(all_pairs, key=lambda p: (-round(p[2], 9), p[0], p[1]))[:12]
        assert top == [(i, j, a == b) for i, j, _, a, b in best]
        want = Counter((a == b, min(int(round(x, 9) * 60), 59)) for _, _, x, a, b in all_pairs)
        assert {(r["same"], r["bin"]): r["n"] for r in pairs.cosine_histogram(df, 60, block).collect()} == want
        above = {r["same"]: (r["n"], r["total"]) for r in pairs.cosine_above(df, 0.55, block).collect()}
        known = [(x, a == b) for _, _, x, a, b in all_pairs if x > 0.55 and None not in (a, b) and min(a, b) >= 0]
        assert above == {same: (sum(s == same for _, s in known), pytest.approx(sum(x for x, s in known if s == same))) for same in (True, False)}
        weak = {(r["i"], r["j"]): r["v"] for r in pairs.cosine_deemphasised(df.select("n", "e", (F.col("label") < 1).alias("entity")), block=block).collect()}
        factor = lambda *ls: (1, 0.8, 0.6)[sum(x is not None and x < 1 for x in ls)]
        assert weak == pytest.approx({(i, j): x * factor(a, b) for i, j, x, a, b in all_pairs})


def test_weakened_cosines_are_not_dealt_out_again(spark):
    from seamline.plans.queries import semantic_deemphasis

    plan = semantic_deemphasis(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("block", [4, 1024])
def test_groups_become_lists(spark, block):
    """Repeated nodes count once, and who reads the similarities reads counts, not the groups again."""
    rng = random.Random(block)
    rows = [(f"g{g}", f"n{rng.randrange(9)}") for g in range(40) for _ in range(rng.choice([1, 3, 12]))]
    groups = {}
    for g, n in rows:
        groups.setdefault(g, set()).add(n)
    occ = Counter(n for ns in groups.values() for n in ns)
    co = Counter(p for ns in groups.values() for p in combinations(sorted(ns), 2))
    df = spark.createDataFrame(rows, "g string, n string")
    assert {(r["i"], r["j"]): r["co"] for r in pairs.cooccurrence(df, block).collect()} == co
    v = pairs.jaccard(df, block)
    assert {(r["i"], r["j"]): r["v"] for r in v.collect()} == pytest.approx({(i, j): c / (occ[i] + occ[j] - c) for (i, j), c in co.items()})
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 2


def test_exact_drops_join_no_keys(spark):
    from seamline.operators import sampling

    df = spark.createDataFrame([(k % 97 if k else None, k) for k in range(500)], "g long, n long")
    keys = [(r["g"], r["_u"]) for r in sampling.hashed(df, "g").collect()]
    for rate in (0.0, 0.37, 0.5, 0.995, 1.0):
        got = sampling.drop_exact(df, "g", rate)
        least = sorted(keys, key=lambda x: (x[1], x[0] is not None, x[0] or 0))[: round((1 - rate) * len(keys))]
        want = {k for k, _ in least} - {None}
        assert sorted(r["n"] for r in got.collect()) == [k for k in range(1, 500) if k % 97 in want]
        assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("tiles", [0, 1, 64, 65, 130])
def test_rounded_tiles_hold_all_pairs(tiles):
    rng, want, given = np.random.default_rng(tiles), {}, []
    for k in range(tiles):
        i, j, s = 10 * k + np.array([0, 4, 8]), 10 * k + np.array([1, 5, 6, 7]), rng.uniform(-1, 1, (3, 4))
        s[0, 1], s[1, 1], s[2, 1], s[2, 2] = -1e-9, 1, -1, np.nan
        pick = None if k % 2 else i[:, None] < j[None, :]
        want |= {(min(x, y), max(x, y), k): np.round(s[a, b], 6) + 0.0 for a, x in enumerate(i.tolist()) for b, y in enumerate(j.tolist()) if pick is None or pick[a, b]}
        given.append((i, j, None, None, s.copy(), pick))
    got = [(x, y, x // 10, v) for c in pairs._rounded_tiles(iter(given), 6) for x, y, v in zip(*(a.tolist() for a in c))]
    assert len(got) == len(want) and {(x, y, k): str(v) for x, y, k, v in got} == {k: str(float(v)) for k, v in want.items()}


def test_all_pairs_take_less_room(spark, tmp_path):
    """A file of all pairs takes less than the eight bytes a pair of their values alone."""
    e = np.random.default_rng(4).normal(size=(3000, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(3000), pa.int64()), "embedding": pa.array(e.tolist(), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    entry.queries()["cosine_pairs"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    t = pq.read_table(tmp_path / "out")
    i, j, v = (np.asarray(t[c]) for c in "ijv")
    u = e.astype(float) / np.linalg.norm(e.astype(float), axis=1, keepdims=True)
    assert len(t) == 3000 * 2999 // 2 == len(set(zip(i.tolist(), j.tolist()))) and (i < j).all()
    assert np.abs(v - np.einsum("nd,nd->n", u[i], u[j])).max() < 5.1e-7
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 7.6 * len(t)


def test_all_weakened_pairs_take_less_room(spark, tmp_path):
    """A file of all pairs takes less than the eight bytes a pair of their values alone."""
    rng = np.random.default_rng(5)
    e, label = rng.normal(size=(3000, 64)).astype(np.float32), rng.integers(0, 6, 3000).astype(np.int32)
    pq.write_table(pa.table({"vec_id": pa.array(range(3000), pa.int64()), "embedding": pa.array(e.tolist(), pa.list_(pa.float32())), "label": label}), tmp_path / "embeddings.parquet")
    entry.queries()["semantic_deemphasis"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    t = pq.read_table(tmp_path / "out")
    i, j, v = (np.asarray(t[c]) for c in "ijv")
    u = e.astype(float) / np.linalg.norm(e.astype(float), axis=1, keepdims=True)
    factor = np.array([1, 0.8, 0.6])[(label[i] < 3).astype(int) + (label[j] < 3)]
    assert len(t) == 3000 * 2999 // 2 == len(set(zip(i.tolist(), j.tolist()))) and (i < j).all()
    assert np.abs(v - np.clip((np.einsum("nd,nd->n", u[i], u[j]) + 1) / 2 * factor, 0, 1)).max() < 5.1e-7
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 7.6 * len(t)


def test_vectors_are_dealt_out_twelve_times(spark):
    """However many there are; and few tasks have pairs of two cells."""
    df = spark.range(30_000).select(F.col("id").alias("n"), F.array(F.col("id").cast("double")).alias("e"), F.lit(0).alias("label"))
    cells = pairs._cells(df, 1024)
    assert cells.count() == 12 * 30_000
    of = Counter(r["p"] for r in cells.select(F.spark_partition_id().alias("p"), "a", "b").distinct().collect())
    assert sum(of.values()) == 78 and len(of) > 55
