import random

import pytest

from seamline.llm import chat

TALK = "conv_id long, turn long, role string, text string, window string, tokens string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TALK)


def check(spark, rows, **settings):
    windows = chat.chat_windows(talk(spark, rows), **settings).collect()
    back = {r["conv_id"]: r for r in chat.read_back(chat.chat_windows(talk(spark, rows), **settings)).collect()}
    source = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for r in sorted(rows, key=key):
        source.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert {c: [tuple(t) for t in b["turns"]] for c, b in back.items()} == source
    assert {c: list(b["loss"]) for c, b in back.items()} == {c: [x for r, x in t if r == "assistant"] for c, t in source.items()}
    return windows


def test_odd_turns_round_trip(spark):
    rows = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"), (1, 0, "system", "be &lt; nice"), (1, 1, "a>b<c", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (1, None, None, "</turn>\n<turn x>"), (None, 3, "assistant", "&amp;amp;"), (None, 3, "user", "é" * 5000)]
    check(spark, rows, budget=200, history=60)
    assert chat.chat_windows(talk(spark, []), 200, 60).count() == 0


def test_budget_history_and_system(spark):
    rng = random.Random(5)
    rows = []
    for c in range(30):
        if c % 2:
            rows.append((c, -1, "system", "s" * rng.randint(1, 100)))
        rows += [(c, t, ("user", "assistant")[t % 2], "x" * rng.randint(0, 400)) for t in range(rng.randint(1, 60))]
    windows = check(spark, rows, budget=400, history=100)
    by = {}
    for w in windows:
        by.setdefault(w["conv_id"], []).append(w)
    assert max(w["tokens"] for w in windows) <= 400  # no turn is longer than the half step
    assert any(w["n_repeated"] > 1 for w in windows)
    assert sum(w["tokens"] for w in windows) > 220 * len(windows)  # more than half full on average
    for c, ws in by.items():
        assert sorted(w["window"] for w in ws) == list(range(len(ws)))
        assert all(w["text"].startswith("<turn system>") for w in ws) == bool(c % 2)
        for w in ws:
            for s in w["loss"]:
                before = w["text"][: s["start"] - 1]
                assert before.endswith("<turn assistant>") and w["text"][s["start"] - 1 + s["length"] :].startswith("</turn>\n")


@pytest.mark.parametrize("size", [1, 2000])
def test_long_turn_is_alone(spark, size):
    windows = check(spark, [(1, 0, "user", "a" * size), (1, 1, "assistant", "b" * 20_000), (1, 2, "user", "c")], budget=100, history=20)
    long = [w for w in windows if "b" * 20_000 in w["text"]]
    assert len(long) == 1 and long[0]["n_turns"] - long[0]["n_repeated"] == 1
