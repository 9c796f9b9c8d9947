import math
import random
import struct
from fractions import Fraction

from seamline.llm import va_topk


def brute(vectors, queries, k):
    ok = lambda e: e is not None and all(x is not None and math.isfinite(x) for x in e)
    whole = [(i, [math.floor(64 * Fraction(x)) for x in e]) for i, e in vectors if i is not None and ok(e)]
    asked = {}
    for i, e in queries:
        if i is not None and ok(e):
            asked[i] = min(asked.get(i, e), e, key=lambda x: (len(x), struct.pack(f"<{len(x)}d", *x)))
    asked = {i: [math.floor(64 * Fraction(x)) for x in e] for i, e in asked.items()}
    out = []
    for q, e in asked.items():
        long = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        found = sorted((-long(sum(a * b for a, b in zip(e, f))), i) for i, f in whole if i != q and len(f) == len(e))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out, key=str)


def test_against_brute_force(spark, rows):
    rng = random.Random(1)
    data = [(i, [float(round(rng.gauss(0, 0.2), 2)) for _ in range(8)]) for i in range(400)]
    data += [(1000, None), (None, [0.5] * 8), (1020, [0.1] * 7 + [None]), (1040, [0.1] * 7 + [float("nan")]), (1060, [0.1] * 7 + [float("inf")]), (1080, [0.0] * 8), (20, data[20][1]), (1100, []), (1120, [1.0])]
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<double>, score string")
    got = va_topk.top_k(df, df.where("vec_id % 20 = 0"), k=5, bits=3, block=16, sample_bytes=2000)
    want = brute(data, [r for r in data if r[0] is not None and r[0] % 20 == 0], 5)
    assert rows(got) == want


def test_cells_meet_over_many_partitions(spark, rows):
    rng = random.Random(2)
    data = [(i, [float(round(rng.gauss(0, 0.2), 2)) for _ in range(6)]) for i in range(300)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = rows(va_topk.top_k(df, df.where("vec_id % 4 = 0"), k=3, block=8))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(data, [r for r in data if r[0] % 4 == 0], 3)


def test_bounds_hold_and_prune():
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.integers(-30, 30, (500, 16)).astype(float)
    low, high = va_topk.Approximations(v, 3).bounds(v[:20].astype(float))
    exact = v[:20] @ v.T
    assert (low <= exact).all() and (exact <= high).all()


def test_few_rows_and_empty(spark, rows):
    one = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert rows(va_topk.top_k(one, one)) == [(0, 1, 20, 64 * 64 * 5), (20, 1, 0, 64 * 64 * 5)]
    assert rows(va_topk.top_k(one.limit(0), one.limit(0))) == []


def test_large_numbers(spark, rows):
    big = spark.createDataFrame([(0, [1e7, -1e7]), (20, [1e7, 1e7]), (40, [3.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r[2:] for r in rows(va_topk.top_k(big, big.where("vec_id = 0")))] == [(40, 640000000 * 192), (20, 0)]


def test_finite_components_of_any_size(spark, rows):
    """Components above 2^62 take part; scores beyond a long are cut to it."""
    data = [(0, [0.0, 1.0]), (20, [1e18, 0.0]), (40, [1e308, 0.0]), (60, [1e18, 1.0]), (80, [-1e300, -1e300])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = rows(va_topk.top_k(df, df.where("vec_id = 0")))
    assert got == [(0, 1, 60, 4096), (0, 2, 20, 0), (0, 3, 40, 0), (0, 4, 80, -(1 << 63))] == brute(data, data[:1], 20)
    many = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(300)] + [(1000, [1e18, 0.0])], "vec_id long, embedding array<double>")
    best = rows(va_topk.top_k(many, many.where("vec_id = 1000"), k=3, block=32))
    assert best == brute([(r["vec_id"], r["embedding"]) for r in many.collect()], [(1000, [1e18, 0.0])], 3)


def test_many_equal_vectors(spark, rows):
    """A vector that most rows share: ties go to the least ids, and repeated rows are candidates each."""
    data = [(i, [1.0, 0.5] if i % 3 else [float(i % 11), -1.0]) for i in range(600)] + [(1, [1.0, 0.5])] * 3
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = rows(va_topk.top_k(df, df.where("vec_id % 50 = 0"), k=7, block=64))
    assert got == brute(data, [(i, e) for i, e in data if i % 50 == 0], 7)


def test_more_equal_rows_than_are_asked_for(spark, rows):
    """Rows of the query's own id, however many, hide no other row with the same vector."""
    v = [1.0, 0.5]
    data = [(5, v)] * 25 + [(6, v), (7, [0.5, 0.25])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert rows(va_topk.top_k(df, df.where("vec_id = 5"))) == [(5, 1, 6, 5120), (5, 2, 7, 2560)]
    data = [(5, v)] * 30 + [(i, v) for i in range(10, 60) for _ in range(1 + 25 * (i == 12))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(6)
    for asked in (5, 12, 40):
        assert rows(va_topk.top_k(df, df.where(f"vec_id = {asked}"))) == brute(data, [(asked, v)], 20)


def test_a_query_of_two_lengths_is_answered_once(spark, rows):
    data = [(0, [2.0, 1.0]), (0, [1.0]), (0, [1.0, 1.0]), (1, [1.0]), (2, [3.0, 3.0]), (3, [2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert rows(va_topk.top_k(df, df.where("vec_id = 0"))) == brute(data, [r for r in data if r[0] == 0], 20) == [(0, 1, 3, 8192), (0, 2, 1, 4096)]
