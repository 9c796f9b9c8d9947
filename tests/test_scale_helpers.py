"""Helpers for large tables against plain versions: ranks and quantiles by ranges, joins on hot keys, tables' folder."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline import workspace
from seamline.operators import cluster, ranges, skew


def test_running_sums_and_ranks(spark, rows):
    rng = random.Random(1)
    data = [(rng.randint(0, 10**6), k, rng.randint(0, 9)) for k in range(3000)]
    df = spark.createDataFrame(data, "a long, k long, x long").repartition(7)
    got = rows(ranges.running(df, [F.col("a").desc(), F.col("k")], {"before": F.col("x"), "nth": F.lit(1)}), "a", "k", "before", "nth")
    total, want = 0, []
    for nth, (a, k, x) in enumerate(sorted(data, key=lambda r: (-r[0], r[1]))):
        want.append((a, k, total, nth))
        total += x
    assert got == sorted(want, key=str)
    assert rows(ranges.ranked(df.limit(0), [F.col("a")])) == []


@pytest.mark.parametrize("n", [1, 2, 1000])
def test_quantiles(spark, n):
    rng = random.Random(n)
    data = [(round(rng.gauss(0, 1), 2), rng.choice([0, 1, 2, 5])) for _ in range(n)] + [(3.0, 1), (None, 4)]
    df = spark.createDataFrame(data, "v double, w long")
    shares = [0.0, 0.05, 0.5, 0.77, 1.0]
    plain = [v for v, _ in data if v is not None]
    assert ranges.quantiles(df, shares).first()[0] == pytest.approx(np.quantile(plain, shares).tolist())
    heavy = [v for v, w in data if v is not None for _ in range(w)]
    assert ranges.quantiles(df, shares, weight=F.col("w")).first()[0] == pytest.approx(np.quantile(heavy, shares).tolist())
    assert ranges.quantiles(df.limit(0), [0.5]).first()[0] in (None, [None])


def test_join_on_hot_keys(spark, rows):
    """A third of all rows share a key; keys that stand once go by the shuffle."""
    keys = [7] * 1000 + list(range(100, 2100)) + [None] * 5
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    counted = left.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    top = {k: max(i for i, x in enumerate(keys) if x == k) for k in set(keys) if k is not None}
    got = rows(skew.join_counted(left, counted, "k", len(keys)), "k", "i", "top")
    assert got == sorted(((k, i, top[k]) for i, k in enumerate(keys) if k is not None), key=str)


def test_small_clusters_move_one_at_a_time():
    """Against the plain rule: the first node of the first small cluster moves, then all is looked at anew."""

    def plain(part, links, least):
        part, stuck = dict(part), set()
        while True:
            size = Counter(part.values())
            small = sorted((c, n) for n, c in part.items() if size[c] < least and n not in stuck)
            if not small:
                return part
            node, tie = small[0][1], Counter()
            for (a, b), w in links.items():
                other = b if a == node else a if b == node else None
                if other is not None and part[other] != part[node]:
                    tie[part[other]] += w
            if tie:
                part[node] = min(tie, key=lambda c: (-tie[c], c))
            stuck.add(node)

    for seed in range(20):
        rng = random.Random(seed)
        part = {n: rng.choice(range(0, 40, rng.choice([1, 3]))) for n in range(40)}
        links = {tuple(sorted(rng.sample(range(40), 2))): rng.randint(1, 4) for _ in range(60)}
        i, j, v = (np.array(x) for x in zip(*((a, b, w) for (a, b), w in links.items())))
        assert cluster.merge_small(part, i, j, v, 4) == plain(part, links, 4)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        workspace.shared_dir(Elsewhere)


def test_tables_are_removed(spark):
    work = workspace.Workspace(spark, "gone")
    table = work.keep(spark.range(3), "t")
    assert table.count() == 3
    workspace._delete(spark, work.root)
    with pytest.raises(Exception):
        work.spark.read.parquet(f"{work.root}/t")


def test_sessions_by_jumps():
    """Against one event after another, with times that go back, are missing, and go on in the next batch."""
    from seamline.operators.sessions import _split

    rng = random.Random(5)
    for _ in range(300):
        cap, n = rng.choice([0, 5, 20]), rng.randint(0, 60)
        t, at = [], 0
        for _ in range(n):
            at += rng.choice([0, 1, 3, 12, -4])
            t.append(-1 if rng.random() < 0.1 else max(0, at))
        anchor, session, want = None, 0, []
        for x in t:
            if x >= 0:
                if anchor is None:
                    anchor = x
                elif cap > 0 and x - anchor > cap:
                    anchor, session = x, session + 1
            want.append(session)
        cut, state, got = rng.randint(0, n), (None, 0), []
        for part in (t[:cut], t[cut:]):
            out = np.empty(len(part), np.int64)
            state = _split(np.array(part, np.int64), out, *state, cap)
            got += out.tolist()
        assert got == want
