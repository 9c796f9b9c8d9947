"""Exact samples, one stream cut into sessions by many tasks, vectors learnt from texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import text
from seamline.operators import pairs, sampling, sessions, terms


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 600])
@pytest.mark.parametrize("sorted_", [1, 1 << 16])
def test_least_hashed(spark, monkeypatch, n, sorted_):
    monkeypatch.setattr(sampling, "SORTED", sorted_)
    df = spark.range(500).repartition(3)
    got = {r["id"] for r in sampling.least_hashed(df, n, "id", seed=3).collect()}
    order = df.orderBy(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 53)), "id").limit(n).collect()
    assert got == {r["id"] for r in order} and len(got) == min(n, 500)


def test_least_hashed_of_equal_rows(spark):
    df = spark.createDataFrame([(1,)] * 30 + [(None,)] * 30, "k long")
    assert sampling.least_hashed(df, 35, "k").count() == 35 and sampling.least_hashed(df.limit(0), 5, "k").count() == 0


@pytest.mark.parametrize(("pos", "hard", "plain", "want"), [(10, 9, 40, (10, 3, 17)), (10, 1, 5, (10, 1, 5)), (0, 4, 4, (0, 0, 0)), (3, 2, 9, (3, 0, 6))])
def test_balanced_pairs(spark, pos, hard, plain, want):
    kinds = [(1, 0.1, 0.9)] * pos + [(0, 0.6, 0.3)] * hard + [(0, 0.59, 0.0)] * plain
    df = spark.createDataFrame([(i, i + 1, *k) for i, k in enumerate(kinds)], "i long, j long, y int, static double, temp double")
    got = sampling.balanced_pairs(df).collect()
    is_hard = [r["y"] == 0 and r["static"] >= 0.6 for r in got]
    assert (sum(r["y"] for r in got), sum(is_hard), sum(r["y"] == 0 for r in got) - sum(is_hard)) == want
    assert sorted(got) == sorted(sampling.balanced_pairs(df.repartition(5)).collect())


def test_rho_name(spark):
    df = spark.createDataFrame([(0.1,), (0.05,), (1.0,)], "x double")
    assert [r[0] for r in df.select(text.rho_name(F.col("x"))).collect()] == ["0p10", "0p05", "1p00"]


def plain_sessions(times, cap):
    anchor, session, out = None, 0, []
    for t in times:
        if t is not None and t >= 0:
            if anchor is None:
                anchor = t
            elif cap > 0 and t > anchor + cap:
                anchor, session = t, session + 1
        out.append(session)
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("ranges", [1, 5])
def test_stream_sessions(spark, seed, ranges):
    """Regular and random gaps, times out of order, unknown times, ranges without any."""
    rng = random.Random(seed)
    t, times = 0, []
    for k in range(400):
        t += 10 if seed == 0 else rng.choice([0, 1, 5, 30, 200])
        times.append(t - rng.choice([0, 0, 0, 60]) if seed > 2 else t)
    if seed > 3:
        times = [rng.choice([x, x, None, -1]) for x in times]
    if seed == 5:
        times[:120] = [None] * 120
        times[200:330] = [-1] * 130
    cap = [35, 70, 400, 100, 90, 150][seed]
    df = spark.createDataFrame([(k, x, "n") for k, x in enumerate(times)], "seq long, t long, n string").repartition(3)
    got = [r["session"] for r in sessions.stream_sessions(df, cap, ranges).orderBy("seq").collect()]
    assert got == plain_sessions(times, cap)


def test_stream_sessions_ends(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, 500, "b")], "seq long, t long, n string")
    assert [r["session"] for r in sessions.stream_sessions(df, 0, 2).collect()] == [0, 0]
    assert sessions.stream_sessions(df.limit(0), 10, 2).count() == 0
    high = np.arange(0, 1000, 7)
    out, opened = sessions._ends(high, 20)
    for k in (0, 1, 50, len(high) - 1):
        s = plain_sessions(high[k:].tolist(), 20)
        assert opened[k] == s[-1] + 1 and out[k] == high[k + s.index(s[-1])]


def test_group_key(spark):
    df = spark.createDataFrame([("a", 3), ("a", -1)], "t string, i int")
    of = lambda *m: [r[0] for r in df.select(sessions.group_key(F.col("t"), F.col("i"), *m)).collect()]
    assert of() == ["a::it=3", "a"] and of("thread") == ["a", "a"] and of("global") == ["global", "global"]
    with pytest.raises(ValueError):
        of("other")


def test_intra_inter_of_odd_vectors(spark):
    """Zero vectors, one of another length, a label that is out."""
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 2.0], 0), (3, [3.0, 3.0], 1), (4, [0.0, 0.0], 1), (5, [1.0, 1.0], -1)]
    got = pairs.cosine_intra_inter(spark.createDataFrame(rows, "n long, e array<double>, label long")).first()
    half = 0.5**0.5
    assert got["n_intra"] == 2 and got["n_inter"] == 4
    assert got["intra"] == pytest.approx(0.5) and got["inter"] == pytest.approx((2 * (half + 1) / 2 + 2 * 0.5) / 4)


def test_learned_vectors(spark):
    """Texts of one theme are nearer than by hashed counts, as few words are common to two of them."""
    rng = random.Random(1)
    words = {g: [f"{g}{chr(97 + a)}{chr(97 + b)}x" for a in range(6) for b in range(8)] for g in ("tax", "sea", "owl", "ink")}
    docs = [(i, " ".join(rng.sample(words[g], 7))) for i, g in enumerate(rng.choice(sorted(words)) for _ in range(240))]
    theme = [t[:3] for _, t in docs]
    df = spark.createDataFrame(docs, "d long, text string")

    def gap(vectors):
        e = np.array([r["e"] for r in vectors.orderBy("d").collect()])
        s = e @ e.T
        same = np.array([[a == b for b in theme] for a in theme])
        np.fill_diagonal(s, np.nan)
        return np.nanmean(s[same]) - np.nanmean(s[~same])

    assert gap(terms.learned_vectors(df, 8)) > 2 * gap(terms.hashed_vectors(df))


def test_learned_vectors_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "sea wind and sail"), (3, "sail sea"), (None, "of a"), (5, "harbour " * 5000)], "d long, text string")
    got = terms.learned_vectors(df, 4).collect()
    assert len(got) == 6 and all(len(r["e"]) == 4 for r in got)
    assert all(sum(x * x for x in r["e"]) == pytest.approx(1 if r["d"] in (3, 5) else 0, abs=1e-6) for r in got)
    assert terms.learned_vectors(df.limit(0)).count() == 0 and terms.learned_vectors(df.limit(1), 4).first()["e"] == [0.0] * 4
