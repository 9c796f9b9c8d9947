"""Every stage of the pipeline against a plain version on the stage's own input."""

import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from seamline.llm import quality
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_mixing import targets
from tests.llm.test_packing import layout
from tests.llm.test_simhash import jaccard_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data absent")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and result of each stage, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "t")
        f(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_names_and_columns(stages, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources", "best-fit packing"]
    for before, after in stages[:-1]:
        assert after.schema == before.schema
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][1].count()


def test_classifier(stages, spark):
    before, after = stages[0]
    trees = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = Counter(r["doc_id"] for r in quality.score(before, trees).collect() if r["score"] >= 0.7)
    assert ids(after) == want and 0 < sum(want.values()) < before.count()


def test_lines(stages):
    before, after = stages[1]
    want = brute_lines([(r["doc_id"], r["text"]) for r in before.collect()])
    had = {r["doc_id"]: r["text"] for r in before.collect()}
    want = {d: t for d, t in want.items() if t.split() or t == had[d]}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if r["text"] != had[r["doc_id"]])


def test_one_of_each_group(stages):
    before, after = stages[2]
    groups = jaccard_components([(r["doc_id"], r["text"]) for r in before.collect()], 0.8, 5)
    assert ids(after) == Counter(min(g) for g in groups)


def test_mix(stages):
    before, after = stages[3]
    size = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in before.collect()}
    total, taken = defaultdict(int), defaultdict(int)
    for s, n in size.values():
        total[s] += n
    times = ids(after)
    assert set(times.values()) <= {1, 2} and set(times) <= set(size)
    for d, k in times.items():
        taken[size[d][0]] += k * size[d][1]
    want, most = targets(total), max(n for _, n in size.values())
    assert all(abs(taken[s] - want[s]) <= most for s in total)


def test_packing(stages):
    before, after = stages[4]
    rows = after.collect()
    full = layout([(r["sequence_id"], r["offset"], r["length"]) for r in rows])
    assert max(full.values()) <= 2048 and len(full) <= 1.02 * sum(full.values()) / 2048 + 1
    assert ids(after.where("piece = 0")) == ids(before)


def test_odd_documents(spark, odd, documents, tmp_path):
    """Null ids, equal rows and clashing columns go through each stage that keeps rows; equal rows share copies."""
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty.write.parquet(str(tmp_path / "labels.parquet"))
    for f in (corpus_pipeline.accept_quality, corpus_pipeline.cut_repeated_lines, corpus_pipeline.keep_one_of_each, corpus_pipeline.mix_sources):
        assert f(spark, odd, str(tmp_path)).columns == odd.columns and f(spark, odd.limit(0), str(tmp_path)).count() == 0
    once = corpus_pipeline.keep_one_of_each(spark, documents([(4, "a b c d e", "s")] * 3 + [(9, "a b c d e", "s"), (12, "q r s t u v", "s")]), "")
    assert ids(once) == Counter([4, 12])
    nameless = corpus_pipeline.keep_one_of_each(spark, documents([(None, "a b c d e", "s")] * 2 + [(None, "q r s t u v", None)]), "")
    assert sorted(r["text"] for r in nameless.collect()) == ["a b c d e", "q r s t u v"]
    mixed = corpus_pipeline.mix_sources(spark, documents([(1, "a b", "s")] * 4 + [(2, "a b c", "s"), (None, "x y", None), (None, "x y z", None)]), "")
    assert all(k <= 8 for k in ids(mixed).values()) and {r["text"] for r in mixed.where("doc_id is null").collect()} <= {"x y", "x y z"}
    assert corpus_pipeline.pack_sequences(spark, odd, "").count() >= odd.count()
