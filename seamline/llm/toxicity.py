"""Toxicity by a weighted finite-state grammar: clauses are matched and scored, not words by themselves.

A lexical transducer reads words by their longest known beginning and gives a class (insult, threat, target, negation, report) and a weight. Five small transducers read the classes
of a clause: an insult; a threat that reaches a target; a target, a negation or a report of speech that stands before. Their composition is one table of states, which says of each insult or threat
whether it is plain, aimed, reported or denied. A document's score is logistic in the sums of its clauses' weights.

Word lists give the first weights. Labelled documents correct them, add words and beginnings of words that go with the label, and fit what each kind of clause counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.llm.quality import held_out
from seamline.workspace import Workspace

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Words of each class in English, German, French and Spanish; * stands for any ending.
LISTS = {
    INSULT: "idiot* moron* imbecile* cretin* stupid* dumb dumbass fool* loser* scum* trash garbage worthless pathetic disgusting clown* pig pigs scumbag* bastard* bitch* asshole* jerk* vermin filth* freak* "
    "dummkopf* trottel* vollidiot* abschaum arschloch* dreckskerl* schwachkopf* ekelhaft* wertlos* connard* abruti* crétin* ordure* minable* salaud* débile* idiota* imbécil* estúpid* basura escoria cabrón* gilipollas payaso* patétic*",
    THREAT: "kill* murder* shoot hurt stab strangle destroy crush burn hang punch töten töte umbringen erschießen schlagen tuer tuerai frapper brûler matar mataré golpear quemar",
    TARGET: "you your you're u he she they them these those people everyone dich dir du ihr euch er sie toi tu te vous ils elles tú ti te usted ustedes ellos ellas",
    NEGATION: "not no never isn't aren't wasn't don't cannot nobody neither nicht kein keine nie niemand pas jamais aucun aucune nunca jamás tampoco",
    REPORT: "said says say saying called calls wrote writes quoted quotes claimed claims told according sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió",
}
#: What an insult or a threat may be; CLEAR ones are meant.
KINDS = ("insult", "aimed insult", "reported insult", "denied insult", "threat", "reported threat", "denied threat")
CLEAR = np.array([1, 1, 0.2, 0.2, 1, 0.2, 0.2])
#: Weights before anything is learned: a constant, each kind, the share of the words, the strongest match.
FIRST = np.array([-2.2, 1.0, 1.3, 0.3, 0.2, 1.3, 0.4, 0.3, 0.3, 0.5])
_CLAUSE, _WORD = re.compile(r"[.!?;\n]"), re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SHORT, LONG = 4, 9  # letters of a beginning that can be learned

Step = Callable[[int, int], tuple[int, int]]


def soon_after(symbol: int, reach: int = 3) -> Step:
    """State: how many more words the symbol reaches. Output 1 while it does."""
    return lambda state, s: (reach if s == symbol else max(0, state - 1), int(state > 0))


def once_seen(symbol: int) -> Step:
    """Output 1 from the symbol to the end of the clause."""
    return lambda state, s: (int(state or s == symbol), state)


def insult(state: int, s: int) -> tuple[int, int]:
    return 0, int(s == INSULT)


def threat(state: int, s: int) -> tuple[int, int]:
    """Output 1 at a target up to three words behind a threatening verb."""
    if s == THREAT:
        return 3, 0
    return (0, 1) if s == TARGET and state else (max(0, state - 1), 0)


def compose(machines: list[Step], symbols: int = 6) -> tuple[list[list[int]], list[list[tuple[int, ...]]]]:
    """One machine that runs all at once: next state and outputs by state and symbol. Only states that can be reached from the start (0) are in it."""
    number, todo, following, outputs = {(0,) * len(machines): 0}, [(0,) * len(machines)], [], []
    for state in todo:
        row, out = [], []
        for s in range(symbols):
            moves = [m(x, s) for m, x in zip(machines, state)]
            to = tuple(x for x, _ in moves)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
            out.append(tuple(o for _, o in moves))
        following.append(row)
        outputs.append(out)
    return following, outputs


def _kind(found: tuple[int, ...]) -> int:
    """The kind that the outputs of the grammar's five machines tell of, or -1."""
    is_insult, is_threat, aimed, denied, reported = found
    if is_insult:
        return 3 if denied else 2 if reported else 1 if aimed else 0
    return (6 if denied else 5 if reported else 4) if is_threat else -1


_NEXT, _OUT = compose([insult, threat, soon_after(TARGET), soon_after(NEGATION), once_seen(REPORT)])
_KIND = [[_kind(o) for o in row] for row in _OUT]


@dataclass
class Grammar:
    """words and beginnings: class and weight of each; weights: as FIRST."""

    words: dict[str, tuple[int, float]]
    beginnings: dict[str, tuple[int, float]]
    weights: np.ndarray

    def look(self, word: str) -> tuple[int, float]:
        """The lexical transducer: a whole word, or else the longest beginning that is known."""
        if hit := self.words.get(word):
            return hit
        for k in range(min(self.longest, len(word)), 2, -1):
            if hit := self.beginnings.get(word[:k]):
                return hit
        return OTHER, 0.0

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.beginnings), default=0)

    def finder(self):
        """An automaton that finds, in one pass over a text, where insults and threats may begin."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for w, (c, _) in [*self.words.items(), *self.beginnings.items()]:
            if c in (INSULT, THREAT):
                found.add_word(w, len(w))
        found.make_automaton()
        return found

    def clause(self, clause: str) -> list[tuple[int, float]]:
        """Kind and weight of each insult and threat of a clause."""
        state, out, verb = 0, [], 0.0
        for word in _WORD.findall(clause):
            symbol, weight = self.look(word)
            if symbol == THREAT:
                verb = weight
            kind = _KIND[state][symbol]
            if kind >= 0:
                out.append((kind, weight if kind < 4 else verb))
            state = _NEXT[state][symbol]
        return out

    def features(self, text: str | None, finder) -> np.ndarray:
        """For each kind the logarithm of one and the sum of its weights; the same of the clear ones in a hundred words; the strongest clear one."""
        x, low = np.zeros(len(FIRST) - 1), (text or "").lower()
        if not len(finder):
            return x
        sums, best, done = np.zeros(len(KINDS)), 0.0, 0
        for end, length in finder.iter(low):
            at = end + 1 - length
            if at < done or at and low[at - 1].isalpha():
                continue
            # From the clause's begin to its end: what is before `done` has been read.
            begin = max((m.end() for m in _CLAUSE.finditer(low, max(done, at - 2000), at)), default=-1)
            if begin < 0:
                begin = done
                for mark in ".!?;\n":
                    begin = max(begin, low.rfind(mark, done, at) + 1)
            stop = _CLAUSE.search(low, at)
            done = stop.start() if stop else len(low)
            for kind, weight in self.clause(low[begin:done]):
                sums[kind] += weight
                best = max(best, weight * CLEAR[kind])
        if sums.any():
            x[: len(KINDS)], x[-1] = np.log1p(sums), best
            x[-2] = np.log1p(100 * (sums @ CLEAR) / max(1, len(low.split())))
        return x

    def score(self, texts: pa.Array, finder) -> np.ndarray:
        x = np.array([self.features(t.as_py(), finder) for t in texts]).reshape(len(texts), len(FIRST) - 1)
        return 1 / (1 + np.exp(-(self.weights[0] + x @ self.weights[1:])))


#: Toxic share of the documents that have a listed word, and for how many documents that counts.
LISTED, BELIEF = 0.75, 4.0
#: Toxic share before anything is known.
BASE = 0.1


def listed() -> tuple[dict[str, int], dict[str, int]]:
    """The lists: class of each whole word, and of each beginning."""
    words, beginnings = {}, {}
    for c, text in LISTS.items():
        for w in text.split():
            (beginnings if w.endswith("*") else words).setdefault(w.rstrip("*"), c)
    return words, beginnings


def grammar(counts: dict[str, tuple[float, float]], base: float, weights: np.ndarray = FIRST) -> Grammar:
    """Grammar of the lists and of counted patterns: w for a word, w* for a beginning, each with the numbers of toxic and other documents that have it.

    The toxic share of a pattern is drawn to that of the longest pattern that it continues, and of a listed one to LISTED; its weight is the logarithm of the odds against `base`.
    """
    known, begun = listed()
    logit = lambda p: math.log(p / (1 - p))
    share: dict[str, float] = {f"{w}*": LISTED for w, c in begun.items() if c in (INSULT, THREAT)}
    seeds = {**share, **{w: LISTED for w, c in known.items() if c in (INSULT, THREAT)}}
    for pattern in sorted({*counts, *seeds}, key=lambda p: (len(p.rstrip("*")), not p.endswith("*"), p)):
        stem = pattern.rstrip("*")
        above = [f"{stem[:k]}*" for k in range(len(stem) - pattern.endswith("*"), 2, -1)]
        prior = seeds.get(pattern) or next((share[a] for a in above if a in share), base)
        toxic, other = counts.get(pattern, (0, 0))
        share[pattern] = (toxic + BELIEF * prior) / (toxic + other + BELIEF)
    words, beginnings = {w: (c, 0.0) for w, c in known.items()}, {w: (c, 0.0) for w, c in begun.items()}
    for pattern, p in share.items():
        of, stem = (beginnings, pattern[:-1]) if pattern.endswith("*") else (words, pattern)
        c = of.get(stem, (INSULT, 0))[0]
        weight = logit(min(max(p, 1e-3), 0.999)) - logit(min(max(base, 1e-3), 0.999))
        if c in (INSULT, THREAT):
            of[stem] = (c, min(weight, 6.0)) if weight > 0.3 else (OTHER, 0.0)
    return Grammar(words, beginnings, weights)


def patterns(text: str) -> set[str]:
    """The words of a text and their beginnings, as patterns."""
    out = set()
    for w in {*_WORD.findall(text.lower())}:
        if SHORT <= len(w) <= 40:
            out.add(w)
            out.update(f"{w[:k]}*" for k in range(SHORT, min(LONG, len(w) - 1) + 1))
    return out


def _counted(rows: DataFrame) -> DataFrame:
    """pattern, toxic, other: labelled documents (y, text) that have each pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def sent() -> pa.RecordBatch:
            names = list({*held[0], *held[1]})
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([held[1][p] for p in names], pa.int64()), pa.array([held[0][p] for p in names], pa.int64())], names=["pattern", "toxic", "other"])
            held[0].clear()
            held[1].clear()
            return batch

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[int(y)].update(patterns(text.as_py() or ""))
                if len(held[0]) + len(held[1]) > 200_000:
                    yield sent()
        yield sent()

    return rows.mapInArrow(run, "pattern string, toxic long, other long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Logistic weights for rows that count n times, drawn to FIRST; the constant hardly so."""
    x, w = np.column_stack([np.ones(len(x)), x]), FIRST.copy()
    pull = np.full(len(w), ridge)
    pull[0] = 0.1
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (n * (y - p)) - pull * (w - FIRST))
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, most_stems: int = 2_000, most_patterns: int = 20_000, column: str = "toxic") -> Grammar:
    """A grammar from at most `sample` labelled rows, those with the least hashes of doc_id, and never from held-out ones.

    docs (doc_id, text), labels (doc_id, toxic 0/1). Null ids, labels and texts teach nothing; equal texts teach once, as toxic if one is. Without labels the lists' weights stand.
    A pattern is learned if it goes with the label more than any of all counted patterns would by chance; of those the `most_stems` strongest, and at most most_patterns that continue them, come to the driver.
    """
    work = Workspace(docs.sparkSession, "toxicity")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y")).where("doc_id is not null and y in (0, 1)")
    picked = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # At most `sample` rows of two numbers are broadcast.
    joined = texts.join(F.broadcast(picked), "doc_id")
    rows = work.keep(joined.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("l")).agg(F.max("y").alias("y"), F.first("text").alias("text")).select("y", "text"), "rows")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not 0 < toxic < n:
        return grammar({}, BASE)
    base = float(toxic / n)
    counts = work.keep(_counted(rows).where("toxic + other >= 3"), "counts")
    met, share = F.col("toxic") + F.col("other"), F.col("toxic") / (F.col("toxic") + F.col("other"))
    term = lambda k, p, q: F.when(F.col(k) > 0, F.col(k) * F.log(p / q)).otherwise(0.0)
    strength = 2 * (term("toxic", share, base) + term("other", 1 - share, 1 - base))
    chance = 2 * math.log(max(2, counts.count())) + 8
    strong = counts.where((F.col("toxic") >= 3) & (share > 2 * base)).withColumn("g", strength).where(F.col("g") > chance).orderBy(F.desc("g"), "pattern").limit(most_stems).collect()
    found = {r["pattern"]: (r["toxic"], r["other"]) for r in strong}
    stems = sorted(p for p in found if p.endswith("*"))
    if stems:
        starts = docs.sparkSession.createDataFrame([(s[:-1],) for s in stems], "stem string")
        begun = F.explode(F.transform(F.sequence(F.lit(SHORT), F.least(F.lit(LONG), F.length("pattern"))), lambda k: F.substring("pattern", 1, k)))
        more = counts.where(met >= 8).where(F.length("pattern") >= SHORT).withColumn("stem", begun).join(F.broadcast(starts), "stem", "left_semi").select("pattern", "toxic", "other").distinct()
        found |= {r["pattern"]: (r["toxic"], r["other"]) for r in more.orderBy(F.desc(met), "pattern").limit(most_patterns).collect()}
    words, begun = listed()
    seeds = [*words, *(f"{w}*" for w in begun)]
    found |= {r["pattern"]: (r["toxic"], r["other"]) for r in counts.where(F.col("pattern").isin(seeds)).collect()}
    start = grammar(_longest(found), base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = start.finder()
        for batch in batches:
            x = [start.features(t.as_py(), finder) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    # Equal rows are counted where they are; `sample` rows of a few numbers at most.
    data = rows.mapInArrow(run, "y double, x array<double>").groupBy("y", "x").agg(F.count("*").alias("n")).collect()
    data.sort(key=lambda r: (r["y"], r["x"]))
    start.weights = _fit(np.array([r["x"] for r in data]), np.array([r["y"] for r in data]), np.array([float(r["n"]) for r in data]))
    return start


def _longest(found: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """found without beginnings nearly all of whose toxic documents have one longer pattern: the longer one says it all."""
    most: dict[str, int] = {}
    for p, (toxic, _) in found.items():
        stem = p.rstrip("*")
        for k in range(SHORT, len(stem) + (not p.endswith("*"))):
            most[f"{stem[:k]}*"] = max(most.get(f"{stem[:k]}*", 0), toxic)
    return {p: c for p, c in found.items() if not p.endswith("*") or most.get(p, 0) < 0.9 * c[0]}


def score(docs: DataFrame, model: Grammar, limit: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 from `limit` on) for each row of docs (doc_id, text).

    Whole texts are read, in one pass and then clause by clause where something may match. A null text counts as an empty one, and both are scored. Null doc_ids stay null, equal rows score equally, no rows give none,
    other columns are ignored. A clause is read once, however long it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = model.finder()
        for batch in batches:
            s = model.score(batch.column(1), finder)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= limit).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
