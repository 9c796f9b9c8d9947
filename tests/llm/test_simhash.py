import random

import numpy as np
import pytest

from seamline.llm import simhash
from seamline.workspace import Workspace


def components(fps, distance):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                label[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), set()).add(fps[i])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def plain(text):
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    s = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("heavy", [8192, 5])  # 5: most buckets of dense groups become grids
def test_links_join_what_all_pairs_join(spark, monkeypatch, distance, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    rng = random.Random(distance)
    fps = set()
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            fps.add(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, distance + 1)))
    fps |= {0, (1 << 64) - 1, 1 << 63, *(1 << b for b in range(12))}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    table = Workspace(spark, "test").keep(spark.createDataFrame([(f,) for f in signed], "fp long"), "fps")
    links = simhash.near_links(table, distance).collect()
    unsigned = lambda x: x & (1 << 64) - 1
    found, groups = {}, []
    for a, b in ((unsigned(r["a"]), unsigned(r["b"])) for r in links):
        merged = {a, b} | found.get(a, set()) | found.get(b, set())
        for x in merged:
            found[x] = merged
    groups = {frozenset(g) for g in found.values()}
    assert groups == components(list(fps), distance)


def test_any_thresholds_reach_the_distance():
    rng = np.random.default_rng(2)
    parts = [list(range(0, 20)), list(range(20, 40)), list(range(40, 64))]
    counts = {(k, c): rng.integers(0, 50, 256).astype(float) for k, p in enumerate(parts) for c in range(-(-len(p) // 8))}
    t = simhash.Thresholds(parts, counts, 10_000, [{3: 9000}, {}, {}], 3)
    fp = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    units = t.choose([simhash.part_values(fp, p) for p in parts])
    assert (units.sum(axis=0) == 4).all() and (units >= 0).all()


def test_parts_hold_all_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (500, 64))
    x[:, 40] = x[:, 3]
    for m in (2, 3, 4):
        parts = simhash.correlated_parts((x.T @ x).astype(float), 500, m)
        assert sorted(b for p in parts for b in p) == list(range(64)) and any({3, 40} <= set(p) for p in parts)


def test_documents(odd):
    got = simhash.near_duplicates(odd).collect()
    src = odd.select("doc_id", "text").collect()
    assert sorted(str((r["doc_id"], r["fp"] & (1 << 64) - 1)) for r in got) == sorted(str((r["doc_id"], plain(r["text"]))) for r in src)
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
    assert by[(None, 0)] == by[(1, 0)] == by[(2, 0)] == by[(3, 0)] == 1
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_null_ids_alone(documents):
    got = simhash.near_duplicates(documents([(None, "a b c d", "s"), (None, "a b c d", "s"), (1, "totally other words here", "s")])).collect()
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == ["(1, 1)", "(None, None)", "(None, None)"]


def test_long_text_is_counted_whole():
    words = [f"w{i}" for i in range(100_000)]
    assert simhash.fingerprint(" ".join(words[:40_000])) == plain(" ".join(words[:40_000])) != simhash.fingerprint(" ".join(words))


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"z{rng.randint(0, 10**6)}"
    return out


def jaccard_components(docs, least, shingle):
    def shingles(t):
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        return {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} - {()}

    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), set()).add(d)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("cell", [1 << 19, 300])  # 300: groups become grids
def test_similar_documents(documents, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(8)
    docs, n = [], 0
    for _ in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([4, 60, 150, 300]))]
        for _ in range(rng.choice([1, 2, 9])):
            docs.append((n, " ".join(edited(rng, words, rng.randint(0, len(words) // 60)))))
            n += 1
    docs += [(n, ""), (n + 1, None), (n + 2, " "), (n + 3, docs[0][1]), (n + 4, docs[0][1].upper())]
    got = {}
    for r in simhash.similar_documents(documents([(d, t, "s") for d, t in docs])).collect():
        got.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert {frozenset(g) for g in got.values()} == jaccard_components(docs, 0.8, 5) and all(c == min(g) for c, g in got.items())


def test_similar_odd_documents(odd):
    got = simhash.similar_documents(odd).collect()
    assert len(got) == odd.count() and simhash.similar_documents(odd.limit(0)).count() == 0
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}


@pytest.mark.parametrize("kind", ["appended", "shortened", "inserted"])
def test_similar_documents_with_blocks(documents, kind):
    """Copies with one block more or less, near a similarity of 0.8 on both sides."""
    rng = random.Random(kind)
    docs = []
    for n in range(40):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 400))]
        block = [f"x{rng.randint(0, 5000)}" for _ in range(int(len(words) * rng.uniform(0.1, 0.3)))]
        at = rng.randint(1, len(words) - 1)
        copy = {"appended": words + block, "shortened": words[: len(words) - int(len(block) * 0.8)], "inserted": words[:at] + block + words[at:]}[kind]
        docs += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(copy))]
    got = {}
    for r in simhash.similar_documents(documents([(d, t, "s") for d, t in docs])).collect():
        got.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert {frozenset(g) for g in got.values()} == jaccard_components(docs, 0.8, 5)


def test_cells_of_a_skewed_value_are_bounded(spark, monkeypatch):
    """A value that most rows share is a grid by its members and by the rows that probe it: no cell is large, and each pair meets once."""
    monkeypatch.setattr(simhash, "HEAVY", 50)
    work = Workspace(spark, "test")
    sizes = {7: (400, 900), 8: (10, 300), 9: (0, 500), 10: (30, 40)}
    rows = [(0, v, v * 10_000 + k, 1) for v, (m, _) in sizes.items() for k in range(m)] + [(0, v, v * 10_000 + 5000 + k, 2) for v, (_, p) in sizes.items() for k in range(p)]
    rows += [(0, 7, 90_000 + k, 3) for k in range(60)]
    entries = work.keep(spark.createDataFrame(rows, "part int, value long, fp long, kind int").selectExpr("part", "value", "fp", "cast(kind as byte) kind"), "entries")
    cells = {}
    for r in simhash._dealt(entries, work).collect():
        c = cells.setdefault((r["value"], r["cell"]), [0, 0])
        c[0] += r["kind"] & 1
        c[1] += r["kind"] >> 1
    assert all(max(c) <= 100 for (v, _), c in cells.items() if v != 9)
    for v, (m, p) in sizes.items():
        more = 60 if v == 7 else 0
        assert sum(c[0] * c[1] for (x, _), c in cells.items() if x == v) == (m + more) * (p + more)


def test_a_large_group_of_copies(documents, monkeypatch):
    """Copies of one text join its leaders; what resembles only some of them is found among the rest."""
    monkeypatch.setattr(simhash, "CELL", 400)
    rng = random.Random(11)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    docs = [(n, " ".join(edited(rng, words, rng.randint(0, 3)))) for n in range(60)]
    chain = list(words)
    for n in range(60, 90):
        chain = edited(rng, chain, 2)  # walks away from the others step by step
        docs.append((n, " ".join(chain)))
    got = {}
    for r in simhash.similar_documents(documents([(d, t, "s") for d, t in docs])).collect():
        got.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert {frozenset(g) for g in got.values()} == jaccard_components(docs, 0.8, 5)


def test_many_short_texts_of_a_group(spark, monkeypatch):
    """Texts of one shingle each, all with a band in common: cells are bounded by their texts too, and every pair of equal shingles is found."""
    monkeypatch.setattr(simhash, "TEXTS", 50)
    cells = []
    whole = simhash._cells
    monkeypatch.setattr(simhash, "_cells", lambda rows, *a: cells.append(rows) or whole(rows, *a))
    rows = [(1, t, 0, bytes(4), np.array([t // 2], np.uint64).tobytes(), 2) for t in range(1, 601)]  # 2k and 2k + 1 are equal
    sets = spark.createDataFrame(rows, "group long, th long, fp long, bands binary, shingles binary, n long")
    work = Workspace(spark, "test")
    found = {frozenset((r["a"], r["b"])) for r in simhash._similar(work.keep(sets, "sets"), 3, 0.8, work).collect()}
    assert found == {frozenset((t, t + 1)) for t in range(2, 600, 2)}
    assert max(r["count"] for r in cells[-1].groupBy("a", "b").count().collect()) < 4 * 50


def test_most_rows_in_one_fingerprint(documents):
    """Half of the rows have one text, and a quarter none."""
    rows = [(i, ["alpha beta gamma delta epsilon"] * 2 + [None, f"one {i} two {i * 7} three {i * 3} four {i + 5}"] , "s") for i in range(2000)]
    got = simhash.near_duplicates(documents([(i, t[i % 4], s) for i, t, s in rows])).collect()
    assert len(got) == 2000
    assert {r["component_id"] for r in got if r["doc_id"] % 4 < 2} == {0} and len({r["component_id"] for r in got if r["doc_id"] % 4 == 2}) == 1
