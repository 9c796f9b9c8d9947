"""Spectral clustering and MoJo over tables against one task."""

import random

import numpy as np
import pytest

from seamline.operators import metrics, spectral


def blocks(n, groups, seed):
    rng = random.Random(seed)
    pairs = {(min(a, b), max(a, b)) for a in range(n) for b in [(a + groups * rng.randrange(1, n // groups)) % n for _ in range(8)] if a != b}
    return [(a, b, 1.0 + rng.random()) for a, b in sorted(pairs)] + [(a, a + 1, 0.05) for a in range(n - 1)] + [(3, 3, 9.0), (5, 6, -1.0)]


def test_embedding_over_tables_equals_dense(spark):
    df = spark.createDataFrame(blocks(160, 4, 1), "i long, j long, v double")
    got = [{r["n"]: r["cluster"] for r in spectral.spectral(df, 4, dense).collect()} for dense in (1024, 0)]
    assert got[0] == got[1] == {n: n % 4 for n in range(160)}
    assert spectral.spectral(df.limit(0), 3).count() == 0


def test_discrete_rotation():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    of = rng.integers(0, 3, 200)
    label = spectral.discrete((np.eye(3)[of] + rng.normal(scale=0.05, size=(200, 3))) @ q * rng.uniform(0.2, 3, (200, 1)))
    assert len({(a, b) for a, b in zip(of.tolist(), label.tolist())}) == 3


@pytest.mark.parametrize("seed", range(3))
def test_rounds_of_asking_equal_taking_in_order(spark, seed):
    rng = random.Random(seed)
    pred = {n: rng.randrange(25) ** 2 // 25 for n in range(300)}
    truth = {n: pred.get(n, 7) if rng.random() < 0.4 else rng.randrange(20) for n in range(20, 320)}
    common = [n for n in pred if n in truth]
    sizes, used, kept = {}, set(), 0
    for n in common:
        sizes[pred[n]] = sizes.get(pred[n], 0) + 1
    for p in sorted(sizes, key=lambda p: (-sizes[p], p)):
        shared = {}
        for n in common:
            if pred[n] == p:
                shared[truth[n]] = shared.get(truth[n], 0) + 1
        for t in sorted(shared, key=lambda t: (-shared[t], t)):
            if t not in used:
                used.add(t)
                kept += shared[t]
                break
    frames = [spark.createDataFrame(sorted(x.items()), "n long, cluster long") for x in (pred, truth)]
    for light in (1 << 16, 0):
        got = metrics.mojo(*frames, light=light).first()
        assert (got["moves"], got["n"]) == (len(common) - kept, len(common)) and got["mojosim"] == pytest.approx(100 * kept / len(common))
    assert metrics.mojo(frames[0].limit(0), frames[1], light=light).count() == 0


def test_all_measures_at_once_equal_each_by_itself(spark):
    rng = random.Random(4)
    parts = [(s, n, rng.randrange(k)) for s, k in (("a", 5), ("b", 1), ("c", 12)) for n in range(60) if rng.random() < 0.9]
    truth = spark.createDataFrame([(n, rng.randrange(6)) for n in range(55)], "n long, cluster long")
    deps = spark.createDataFrame([(rng.randrange(70), rng.randrange(60), float(rng.randint(1, 4))) for _ in range(300)], "source long, target long, w double")
    every = spark.createDataFrame(parts, "setting string, n long, cluster long")
    for light in (1 << 16, 0):
        got = {r["setting"]: r for r in metrics.measures(every, truth, deps, ("setting",), light).collect()}
        assert set(got) == {"a", "b", "c"}
        for s in got:
            part = every.where(f"setting = '{s}'").select("n", "cluster")
            k = metrics.k_report(part, truth).first()
            n, c, m = metrics.ned(part).first(), metrics.coupling(deps, part).first(), metrics.structural_modularity(deps, part).first()
            want = (n["k"], k["gt_k"], k["k_diff"], metrics.bcubed(part, truth).first()["f1"], metrics.pairwise_f1(part, truth).first()["f1"], metrics.mojo(part, truth).first()["mojosim"], c["ifn"], c["icp"], n["ned"], m["sm"])
            assert tuple(got[s])[1:] == pytest.approx(want)
