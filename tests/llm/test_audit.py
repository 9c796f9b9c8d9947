"""Every order of the filters, run one after another over the documents, against the counts."""

import re
from itertools import permutations

from seamline.llm import audit


def brute(docs, labels):
    """docs: doc_id, text, source; labels: doc_id, quality, toxic. Rows of the audit by part, order and step."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    fails = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        said = lambda k: d is not None and any(r[0] == d and r[k] == 1 for r in labels)  # noqa: B023, E731
        fails.append((s or "", {k for k, v in f.items() if v}, said(1), said(2)))
    out = {}
    for part in {x[0] for x in fails}:
        own, shapley = [x for x in fails if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                shapley[f] += len(gone)
                redundant = sum(f in x[1] for x in own) - len(gone)
                left = [x for x in left if f not in x[1]]
                out[part, order, k + 1] = [len(left), len(gone), redundant, sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_against_every_order(spark, documents):
    base = " ".join(f"w{i}" for i in range(60))
    few, caps = "x " * 80, "ABC DEF " * 40
    docs = [
        (None, None, None), (None, base, "a"), (None, base, "a"), (1, None, "a"), (2, "", None), (3, " \n\t\x0b ", "a"), (4, base, "b"), (4, base, "b"), (9, base, "a"), (9, base, "a"), (5, few, "a"), (6, few, "b"), (7, caps, "b"),
        (8, caps + "#", "b"), (10, base + " $", None), (11, base + " $", "a"), (12, "é \x1c" * 70, "é"), (13, base.upper(), "a"), (14, base.upper(), "b"), (15, base + " a|b A A A", ""), (16, base, None), (17, base + "\x85  x", "b"),
    ]
    labels = [(4, 1, 0), (5, 1, 1), (6, 0, 1), (9, None, 1), (9, 1, 0), (13, 1, None), (None, 1, 1), (2, 1, 0), (999, 1, 1)]
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(docs, labels)
    for n in (1, 7):
        got = audit.audit(documents(docs).repartition(n), said).collect()
        assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in got} == want and len(got) == len(want)


def test_many_copies_and_empty(spark, documents):
    """One text in a third of all rows, over many parts."""
    docs = [(i, "same text" if i % 3 == 0 else f"text {i} " * 60, f"s{i % 5}") for i in range(900)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in audit.audit(documents(docs), none).collect()}
    assert sum(got[f"s{k}", "EABCD", 1][1] for k in range(5)) == 299 and got["s0", "EABCD", 1][0] == 180 - 59
    assert audit.audit(documents(docs).limit(0), none).count() == 0


def test_no_python_on_the_way(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    plan = audit.audit(documents([(1, "a", "b")]), none)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan
