import random

from seamline.llm import line_dedup


def brute(docs, size=3):
    """docs: (doc_id, text) with distinct ids. Text left for each."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        lines = text.split("\n")
        full = [(i, x.strip(" \t\r\v\f")) for i, x in enumerate(lines) if x.strip(" \t\r\v\f")]
        gone = set()
        for a in range(len(full) - size + 1):
            key = tuple(x for _, x in full[a : a + size])
            if key in seen:
                gone.update(range(full[a][0], full[a + size - 1][0] + 1))
            seen.add(key)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_against_brute_force(documents):
    rng = random.Random(2)
    docs = [(i, "\n".join(rng.choice(["a", "b ", " c", "", "d", "e"]) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents([(*r, "s") for r in docs])).collect()}
    assert got == brute(docs)


def test_odd_documents(odd):
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[9]["text"] == "l0\nl5" and by[9]["n_removed"] == 3
    assert by[8]["_key"] == "x" and by[8]["row"] == "x"  # other columns pass
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(documents):
    text = "p\nq\nr"
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(documents([(1, text, "a"), (1, text, "a"), (None, text, "a"), (2, f"x\n{text}", "b")])).collect()), key=str)
    assert got == [(1, text), (1, text), (2, "x"), (None, "")]
