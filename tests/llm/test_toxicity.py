import random
import zlib

import numpy as np
import pyarrow as pa

from seamline.llm import toxicity
from seamline.llm.toxicity import BASE, KINDS, grammar


def test_composition_equals_machines_side_by_side():
    machines = [toxicity.insult, toxicity.threat, toxicity.soon_after(toxicity.TARGET), toxicity.soon_after(toxicity.NEGATION), toxicity.once_seen(toxicity.REPORT)]
    following, outputs = toxicity.compose(machines)
    rng = random.Random(1)
    for _ in range(200):
        state, each = 0, [0] * len(machines)
        for s in (rng.randrange(6) for _ in range(12)):
            moves = [m(x, s) for m, x in zip(machines, each)]
            assert outputs[state][s] == tuple(o for _, o in moves)
            state, each = following[state][s], [x for x, _ in moves]


def test_clauses():
    g = grammar({}, BASE)
    kinds = lambda text: [KINDS[k] for k, _ in g.clause(text.lower())]
    assert kinds("the idiot came home") == ["insult"] and kinds("You are an idiot") == ["aimed insult"] and kinds("you are not an idiot") == ["denied insult"]
    assert kinds("he said that she is a moron") == ["reported insult"] and kinds("I will kill you") == ["threat"] and kinds("we would never kill you") == ["denied threat"]
    assert kinds("he wrote to kill them") == ["reported threat"] and kinds("kill the process and go on with your work") == [] and kinds("idiotische Scumbags") == ["insult", "insult"]
    finder = g.finder()
    score = lambda t: g.score(pa.array([t]), finder)[0]
    assert score("Nice day. You are an idiot!") > score("Nice day. The idiot came.") > score('Nice day. He said "idiot".') > score("Nice day.") == score(None) == score("")
    assert score("You are not an idiot. Fine.") < score("You are an idiot. Fine.")
    # A match inside a word isn't one, and other clauses don't count.
    assert score("videoclown") == score("x") and score("No. You idiot.") == score("Yes. You idiot.")


def test_one_clause_of_any_length():
    g = grammar({}, BASE)
    finder = g.finder()
    long = "word " * 50_000 + "idiot " * 20_000
    assert np.isclose(g.features(long, finder)[0], np.log1p(20_000 * g.look("idiot")[1]))
    assert g.features("a. " * 100_000 + "idiot", finder)[0] == g.features("idiot", finder)[0]


def corpus(n=1500):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(15, 120))]
        if bad := i % 5 == 0:
            words[rng.randrange(len(words))] = f"zorrk{word()[:3]}"
            words.append(rng.choice(["quuxly", "blarg"]))
        out.append((i, " ".join(words) + ".", int(bad)))
    return out


def test_learns_words_and_beginnings_without_held_out_labels(spark, documents):
    rows = corpus()
    docs = documents([(i, t, "s") for i, t, _ in rows])
    out = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    # held-out labels are turned round: whoever learns them does badly
    labels = spark.createDataFrame([(i, 1, 1 - q if i in out else q) for i, _, q in rows] + [(None, 1, 0), (3, 1, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert {"quuxly", "blarg"} <= set(model.words) and "zorrk" in model.beginnings
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == q for i, _, q in rows if i in out) >= 0.97 * len(out)
    again = toxicity.train(docs.repartition(7), labels)
    assert again.words == model.words and again.beginnings == model.beginnings and np.allclose(again.weights, model.weights)


def test_weights_by_hand():
    g = grammar({"idiot": (0, 40), "abcd*": (30, 0), "abcde*": (5, 45), "abcdx": (10, 0)}, 0.1)
    assert g.look("idiot")[0] == toxicity.OTHER and g.look("abcdq")[1] > 3 and g.look("abcdx")[1] > 3
    p = (5 + 4 * (30 + 0.4) / 34) / 54
    assert abs(g.look("abcdef")[1] - max(0, np.log(p / (1 - p)) - np.log(1 / 9))) < 1e-9


def test_no_labels_and_odd_documents(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, none)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(r["score"] < 0.3 and r["predicted"] == 0 for r in got)
    assert toxicity.score(odd.limit(0), model).count() == 0 and toxicity.train(odd.limit(0), none).words == model.words
    one = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, toxicity.train(odd, one)).collect())
