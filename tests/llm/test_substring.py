import random

import numpy as np
import pytest

from seamline.llm import substring


def brute(docs, k):
    first = {}
    split = [(d, (t or "").encode("utf-8", "surrogatepass").split()) for d, t in docs]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - k + 1):
                s = tuple(w[i : i + k])
                first[s] = min(d, first.get(s, d))
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - k + 1):
                if first[tuple(w[i : i + k])] < d:
                    gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode("utf-8", "surrogatepass")))
    return sorted(out, key=str)


def corpus(rng, n, vocabulary):
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 30))] for _ in range(6)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 20))]
        out.append((i if rng.random() < 0.95 else None, "".join(w + rng.choice([" ", "\n", "\t "]) for w in words)))
    return out


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 300, 1])  # 1: every slot is too large for a bucket
@pytest.mark.parametrize("k,m", [(13, 3), (4, 2), (3, 3)])
def test_against_brute_force(documents, rows, k, m, bucket_bytes):
    docs = corpus(random.Random(k + bucket_bytes), 60, ["a", "b", "é", "dd", "x\x1cy", " ", "e" * 40])
    docs += [docs[5], (7, docs[8][1]), (70, docs[3][1]), (71, None), (72, ""), (73, "a " * 500)]
    got = substring.remove_repeats(documents([(*r, "s") for r in docs]), k, m, bucket_bytes)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept") == brute(docs, k)


def test_odd_documents(odd, rows):
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert rows(substring.remove_repeats(odd)) == brute(docs, 13)
    assert rows(substring.remove_repeats(odd.limit(0))) == []


def test_equal_hashes_of_different_windows_are_told_apart():
    """Two windows with one hash, in either order of documents, take their own least document."""
    text = b"aa bb\ncc dd\naa bb\n"
    order, group, new = np.array([0, 1, 2]), np.array([0, 0, 0]), np.array([0])
    doc = np.array([5, 1, 9])
    low = np.array([1, 1, 1])
    substring._settle_collisions(order, group, new, low, doc, np.array([0, 6, 12]), np.array([5, 5, 5]), text)
    assert low.tolist() == [5, 1, 5]


def test_strings_stay_packed_as_the_corpus_grows(documents):
    """Buckets follow the bytes of the corpus: of varied texts nothing goes as rows, whatever the size, and a common passage is split off."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)] + ["the", "of"] * 300
    for n in (20, 2000):
        docs = documents([(i, " ".join(rng.choice(words) for _ in range(60)), "s") for i in range(n)]).select("doc_id", F.xxhash64("text").alias("th"), "text")
        layout, total = substring.plan(docs, 13, 3, 4000)
        assert len(layout.rows) == 0 and layout.buckets >= total / 4000
    # a passage in each document fills its buckets: those are split, and what can't be goes as rows
    passage = " ".join(words[:40])
    docs = documents([(i, " ".join(rng.choice(words) for _ in range(20)) + " " + passage, "s") for i in range(1500)]).select("doc_id", F.xxhash64("text").alias("th"), "text")
    layout, _ = substring.plan(docs, 13, 3, 20_000)
    assert 0 < len(layout.split) < 40 and (layout.parts > 1).all() and 0 < len(layout.rows) < 100
