import math

import numpy as np
import pytest

from seamline.llm import whiten

SCHEMA = "vec_id long, embedding array<double>, x string, dim string, w string"


def check(rows, vectors, k=8):
    """Rows of the query against numpy, for vectors of one length."""
    ok = [(i, e) for i, e in vectors if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in e] for _, e in ok], object)
    n, s = len(x), x.sum(axis=0)
    deviation = {}
    for (i, _), row in zip(ok, x):
        deviation.setdefault(i, []).append(int(((n * row - s) ** 2).sum()))
    c = ((n * x - s) / n).astype(float)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    assert len(rows) == n * min(k, x.shape[1]) and {r["n"] for r in rows} == {n}
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] <= 1e-4
    for m in range(min(k, x.shape[1])):
        own = [r for r in rows if r["component"] == m + 1]
        assert sorted((r["vec_id"], int(r["deviation"])) for r in own) == sorted((i, d) for i, ds in deviation.items() for d in ds)
        assert all(r["explained"] == pytest.approx(e[m] / e.sum(), rel=1e-4) for r in own)
        want = dict(zip([i for i, _ in ok], c @ v[:, m] / math.sqrt(e[m])))
        sign = np.sign(sum(want[r["vec_id"]] * r["whitened"] for r in own))
        assert all(r["whitened"] == pytest.approx(sign * want[r["vec_id"]], abs=1e-6) for r in own)


def test_against_eigh(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(12, 12)) * np.linspace(3, 0.1, 12)
    data = [(i, [float(c) for c in rng.normal(size=12) @ mix]) for i in range(300)]
    data += [(900, None), (901, [1.0] * 11 + [None]), (902, [1.0] * 11 + [float("nan")]), (903, [float("inf")] * 12)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in data], SCHEMA).repartition(5)
    check([r.asDict() for r in whiten.whitened(df).collect()], data)
    check([r.asDict() for r in whiten.whitened(df, k=3).collect()], data, k=3)


def test_lengths_nulls_and_repeats(spark):
    rng = np.random.default_rng(6)
    data = [(None, [1.0, 2.0]), (7, [3.0, -2.0]), (7, [3.0, -2.0]), (8, [0.5, 0.25]), (9, []), *((20 + i, [float(c) for c in rng.normal(size=3)]) for i in range(9))]
    got = whiten.whitened(spark.createDataFrame([(*r, "a", "b", "c") for r in data], SCHEMA)).collect()
    two, three = [r for r in got if r["n"] == 4], [r for r in got if r["n"] == 9]
    assert len(two) == 8 and len(three) == 27 and len(got) == 35 and sum(r["vec_id"] is None for r in got) == 2
    assert len({r["whitened"] for r in two if r["vec_id"] == 7}) == 2 and sum(r["explained"] for r in three if r["vec_id"] == 20) == pytest.approx(1)


def test_no_variance(spark):
    same = spark.createDataFrame([(i, [1.5, 2.5], "a", "b", "c") for i in range(4)], SCHEMA)
    for df in (same, same.limit(1)):
        got = whiten.whitened(df).collect()
        assert {(r["component"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, None, 0.0), (2, 0, None, None, 0.0)}
    flat = spark.createDataFrame([(i, [float(i), 1.0, 1.0], "a", "b", "c") for i in range(5)], SCHEMA)
    got = whiten.whitened(flat).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) and r["explained"] == pytest.approx(float(r["component"] == 1)) for r in got)
    assert whiten.whitened(same.limit(0)).collect() == []


def test_large_numbers(spark):
    data = [(i, [1e12 * i, -1e11 * i * i]) for i in range(6)]
    got = whiten.whitened(spark.createDataFrame([(*r, "a", "b", "c") for r in data], SCHEMA)).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in e] for _, e in data]
    s = [sum(c) for c in zip(*x)]
    assert {(r["vec_id"], int(r["deviation"])) for r in got} == {(i, sum((6 * a - b) ** 2 for a, b in zip(row, s))) for i, row in enumerate(x)}
    beyond = whiten.whitened(spark.createDataFrame([(0, [1e300], "a", "b", "c"), (1, [0.0], "a", "b", "c")], SCHEMA)).collect()
    assert all(abs(r["whitened"]) == pytest.approx(1) for r in beyond)


def test_squares():
    rng = np.random.default_rng(7)
    for top in (10, 1 << 40, 1 << 60):
        d = rng.integers(-top, top, (20, 9))
        assert whiten._squares(d) == [sum(v * v for v in row) for row in d.tolist()]
