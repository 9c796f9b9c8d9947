import random
import time
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from seamline.llm import mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Water filling by repeated sharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    t = {s: share * sum(sizes.values()) * w[s] / sum(w.values()) for s in names}
    capped = set()
    while over := [s for s in names if s not in capped and t[s] > most * sizes[s] + 1e-9]:
        for s in over:
            capped.add(s)
        free = [s for s in names if s not in capped]
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        for s in names:
            t[s] = most * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free)
    return t


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken(documents, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(1500)]
    got = mixing.mix(documents(rows), group=100).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert r["copies"] in (0, 1, 2) and (r["size"] or not r["copies"])
    want = targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 200
    again = mixing.mix(documents(rows[::-1]).repartition(7), group=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))  # whatever the order and the partitions


def test_probability_is_kept():
    total, chances = [0] * 6, [0.5, 0.3, 0.7, 0.7, 0.1, 0.9]
    for seed in range(3000):
        out = mixing.settle(list(range(6)), "a", [5, 4, 3, 3, 2, 1], chances, seed, True)
        assert set(out) <= {0.0, 1.0}
        total = [a + b for a, b in zip(total, out)]
    assert all(abs(t / 3000 - p) < 0.04 for t, p in zip(total, chances))


def test_repeated_rows_share_their_copies(documents):
    rows = [(7, "a b c", "s")] * 5000 + [(8, "x " * 40, "t"), (None, None, None), (9, "", "s")]
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    assert len({r["copies"] for r in got if r["doc_id"] == 7}) <= 2
    s = [r for r in got if r["source"] == "s"]
    assert abs(sum(r["size"] * r["copies"] for r in s) - s[0]["target"]) <= 3


def test_large_ids_beside_a_null(documents):
    """Ids above 2^53 come back as they are, whatever stands in their group."""
    ids = [(1 << 60) + 2 * k + 1 for k in range(5)] + [None, -(1 << 62) - 3]
    got = mixing.mix(documents([(i, "a b c", "s") for i in ids])).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, ids))
    mixed = corpus_pipeline.mix_sources(documents([]).sparkSession, documents([(i, "a b c", "s") for i in ids] + [(9, "x " * 20, "t")]), "")
    words = Counter(r["doc_id"] for r in mixed.where("source = 's'").collect())
    assert set(words) <= set(ids) and sum(words.values()) == 14  # a small source is taken twice


def test_many_sources(documents):
    """A source for each document: targets come from sums over ranges of sources."""
    rows = [(i, " ".join(["w"] * (i % 17)), f"host{i}") for i in range(700)]
    got = {r["source"]: r["target"] for r in mixing.mix(documents(rows)).collect()}
    want = targets({s: len(t.split()) for _, t, s in rows})
    assert got == pytest.approx(want)


def test_groups_over_batches(spark, documents):
    """Groups that go on in the next batch are settled as a whole, a null source's too."""
    rng = random.Random(4)
    docs = documents([(i, " ".join(["w"] * rng.randrange(1, 9)), rng.choice([None, "a", "b", f"s{i // 3}"])) for i in range(400)]).coalesce(1)
    want = sorted(map(str, mixing.mix(docs).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, mixing.mix(docs).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sources_as_many_as_documents(documents):
    """Small sources cost no Python group each: 20,000 of three words settle within the time of a few jobs."""
    began = time.time()
    got = mixing.mix(documents([(i, "a b c", f"host{i}") for i in range(20_000)])).groupBy("copies").count().collect()
    assert sum(r["count"] for r in got) == 20_000 and time.time() - began < 60


def test_empty(odd):
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mix(odd).count() == odd.count()
