import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from seamline.llm import quality


def corpus(n=400):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(15, 120))]
        if bad := i % 4 == 0:
            words = [f"{w}%%%" for w in words] if i % 8 else [w for w in words for _ in range(6)]
        out.append((i, " ".join(words) + ".", int(not bad)))
    return out


def test_learns_without_held_out_labels(spark, documents):
    rows = corpus()
    docs = documents([(i, t, "s") for i, t, _ in rows])
    # held-out labels are turned round: whoever learns them does badly
    out = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    labels = spark.createDataFrame([(i, 1 - q if i in out else q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert {r["doc_id"] for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).where("h").collect()} == out
    right = sum(got[i]["predicted"] == q for i, _, q in rows if i in out)
    assert right >= 0.95 * len(out)


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    t = quality.fit_trees(x, (x[:, 0] * x[:, 1] > 0).astype(float), rounds=10)
    for row, s in zip(x[:50], t.score(x[:50])):
        raw = t.base
        for at in t.roots:
            while t.left[at] != at:
                at = t.left[at] if row[t.feature[at]] <= t.limit[at] else t.right[at]
            raw += t.value[at]
        assert abs(1 / (1 + np.exp(-raw)) - s) < 1e-12


def test_no_labels_and_odd_documents(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    trees = quality.train(odd, none)
    got = quality.score(odd, trees).collect()
    assert len(got) == odd.count() and all(r["score"] == 0.5 for r in got)
    assert quality.score(odd.limit(0), trees).count() == 0
    kept = quality.accepted(odd, trees, limit=0.5)
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd.collect())) and kept.columns == odd.columns
    one = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, quality.train(odd, one)).collect())
