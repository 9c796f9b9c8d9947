import random
from collections import defaultdict

from seamline.llm import repetition


def brute(words, least):
    """Covered words, the longest repeat, and the maximal repeats, from all substrings."""
    n, covered, longest, maximal = len(words), set(), 0, 0
    for length in range(1, n):
        at = defaultdict(list)
        for i in range(n - length + 1):
            at[tuple(words[i : i + length])].append(i)
        many = [v for v in at.values() if len(v) > 1]
        if not many:
            break
        if length >= least:
            longest = length
            for v in many:
                left = {words[i - 1] if i else ("start", i) for i in v}
                right = {words[i + length] if i + length < n else ("end", i) for i in v}
                maximal += len(left) > 1 and len(right) > 1
                for i in v:
                    covered.update(range(i, i + length))
    return len(covered), longest, maximal


def test_against_all_substrings():
    rng = random.Random(1)
    for _ in range(60):
        docs = [[rng.choice([b"a", b"b", b"c"][: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))] for _ in range(4)]
        for least in (1, 2, 3, 8):
            assert list(zip(*(x.tolist() for x in repetition.repeats(docs, least)))) == [brute(d, least) for d in docs]


def test_rows_of_odd_documents(odd, spark):
    got = repetition.repetition_rules(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[5]["n_words"] == 30_000 and by[5]["kept"]
    assert by[10]["word_chars"] == len("\U0001f600é \x1cx")
    assert repetition.repetition_rules(odd.limit(0)).count() == 0


def test_verdicts(documents):
    clean = " ".join(f"w{i}" for i in range(60))
    line = " ".join(f"v{i}" for i in range(12))
    docs = documents([(1, clean, "a"), (2, "\n".join([line] * 5), "a"), (3, f"{clean} {line} {line}", "a"), (4, " ".join(f"u{i}" for i in range(900)) + f" {clean} and b {clean}a {clean}", "a"), (5, "a b\na b\n\n\nc", "a")])
    got = {r["doc_id"]: r for r in repetition.repetition_rules(docs, max_longest=40).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and got[2]["base_failed"] and got[3]["kept"]
    assert not got[4]["kept"] and not got[4]["base_failed"] and got[4]["longest_repeat"] >= 59  # the longest repeat is too long
    assert got[5]["n_dup_lines"] == 1
    assert got[2]["n_dup_lines"] == 4 and got[2]["n_repeat_words"] == 60
