import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seamline.llm import packing
from seamline.llm.queries import tokenizer


def sequential(lengths, capacity):
    """Best-fit decreasing, one piece after another: the remaining room of each bin."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return Counter(bins)


def layout(placed):
    bins = defaultdict(list)
    for s, o, n in placed:
        bins[s].append((o, n))
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
    return {s: sum(n for _, n in b) for s, b in bins.items()}


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    placed = []
    for n, rank, count, each, first, offset in packing.best_fit_plan(dict(Counter(lengths)), capacity):
        placed += [(first + k // each, offset + k % each * n, n) for k in range(count)]
    assert Counter(n for _, _, n in placed) == Counter(lengths)
    assert Counter(capacity - x for x in layout(placed).values()) == sequential(lengths, capacity)


def test_documents_round_trip(odd):
    from tokenizers import Tokenizer

    t = tokenizer()
    pieces, placed = packing.pack_tables(odd, **t)
    exact = Tokenizer.from_file(t["json_path"])
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        want[(r["doc_id"], tuple(exact.encode(r["text"] or "", add_special_tokens=False).ids + [0]))] += 1
    rows = pieces.collect()
    single = Counter()
    for d, ids in want:
        n = len(ids)
        bounds = sorted({0, *range(n, 0, -2048)})
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            single[(d, k, a, b - a, np.array(ids[a:b], "<u4").tobytes())] += want[(d, ids)]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == single
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in rows)
    out = placed.collect()
    assert len(out) == len(rows) and max(layout([(r["sequence_id"], r["offset"], r["length"]) for r in out]).values()) <= 2048


def test_fast_ids_equal_exact_ones():
    from tokenizers import Tokenizer

    t = tokenizer()
    tokens, exact = packing.Tokens(separator=0, **t), Tokenizer.from_file(t["json_path"])
    rng = random.Random(3)
    alphabet = [chr(c) for c in range(packing._PLAIN_LIMIT)] + list(" \n'ste1’—")
    texts = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(3000)] + ["a<|endoftext|>b", "  x\n\n y\t", "中文 \U0001f600", "it's I'LL  "]
    texts += [f"a{chr(c)}1 {chr(c)}{chr(c)} b" for c in range(packing._PLAIN_LIMIT)] + [f"a{chr(c)}1 {chr(c)}" for c in range(0x2010, 0x2028)]
    for text in texts:
        assert tokens.ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids + [0], repr(text)


def test_invalid_lengths_and_clashes(spark):
    df = spark.createDataFrame([(1, 0, 5, "x", "y"), (2, 0, None, "x", "y"), (3, 0, 0, "x", "y"), (4, 0, 11, "x", "y"), (1, 0, 5, "x", "y")], "doc_id long, piece int, length long, sequence_id string, _slot string")
    got = packing.pack(df, 10).collect()
    assert sorted((r["doc_id"], r["sequence_id"], r["_slot"]) for r in got) == sorted([(1, 0, "y"), (1, 0, "y"), (2, None, "y"), (3, None, "y"), (4, None, "y")], key=str) or sorted((r["doc_id"], str(r["sequence_id"]), r["_slot"]) for r in got) == [(1, "0", "y"), (1, "0", "y"), (2, "None", "y"), (3, "None", "y"), (4, "None", "y")]
    assert packing.pack(df.limit(0), 10).count() == 0
