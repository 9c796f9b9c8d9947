"""A quality classifier: histogram gradient-boosted trees over statistics of a document.

The trees are fitted with numpy on a bounded sample of labelled rows and flattened into arrays; documents are scored where they lie, a batch at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FEATURES = (
    "log_words", "log_chars", "word_length", "word_length_sd", "long_words", "short_words", "capital_words", "upper", "digits", "symbols", "bars", "exclamations", "marks", "sentence_ends",
    "non_ascii", "line_feeds", "log_line_words", "repeated_lines", "distinct_words", "top_word", "echoes", "distinct_pairs", "worst_window", "packed",
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&<>@^~_=+\\{}[]")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:?!'\"()-")] = True


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; all zero for one without words."""
    import zstandard

    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, solid = len(data), max(1, int(count.sum() - count[[9, 10, 11, 12, 13, 32]].sum()))
    length = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    seen = Counter(words)
    echoes = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    # the poorest stretch of 64 words: junk in a part of a long text shows there
    worst = min(len(set(words[i : i + 64])) / min(64, n - i) for i in range(0, max(1, n - 32), 64))
    return [
        np.log1p(n), np.log1p(size), length.mean(), length.std(), (length > 12).mean(), (length < 4).mean(), sum(w[:1].isupper() for w in words) / n,
        count[65:91].sum() / solid, count[48:58].sum() / solid, count[_SYMBOLS].sum() / solid, count[124] / n, count[33] / n, count[_MARKS].sum() / n, (count[46] + count[63]) / n,
        count[128:].sum() / solid, count[10] / n, np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), len(seen) / n, max(seen.values()) / n, echoes / n, pairs, worst,
        len(zstandard.ZstdCompressor(level=1).compress(data)) / size,
    ]


@dataclass
class Trees:
    """Trees in flat arrays: node i goes left if its feature is at most its limit; a leaf points at itself and holds a value."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosted trees for logistic loss. No rows: every score is 0.5; one label only: about that label."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    nodes: list[list[float]] = []  # feature, limit, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        flat = binned + np.arange(x.shape[1]) * bins
        raw = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            roots.append(_grow(np.arange(len(y)), g, h, binned, flat, edges, nodes, raw, depth, rate, bins, least, ridge))
    table = np.array(nodes, float).reshape(-1, 5)
    return Trees(base, table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4], np.array(roots, np.int64), depth)


def _grow(rows, g, h, binned, flat, edges, nodes, raw, depth, rate, bins, least, ridge) -> int:
    me = len(nodes)
    nodes.append([0, np.inf, me, me, 0.0])
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best, pick = 1e-6, None
    if depth and len(rows) >= 2 * least:
        width = binned.shape[1]
        cells = flat[rows].ravel()
        hist = [np.bincount(cells, np.repeat(v[rows], width) if v is not None else None, minlength=width * bins).reshape(width, bins).cumsum(axis=1) for v in (g, h, None)]
        lg, lh, ln = hist
        gain = lg**2 / (lh + ridge) + (total_g - lg) ** 2 / (total_h - lh + ridge) - total_g**2 / (total_h + ridge)
        gain[(ln < least) | (len(rows) - ln < least)] = 0
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, b] > best and b < len(edges[f]):
            pick = (int(f), int(b))
    if pick is None:
        nodes[me][4] = rate * total_g / (total_h + ridge)
        raw[rows] += nodes[me][4]
        return me
    f, b = pick
    low = binned[rows, f] <= b
    args = (g, h, binned, flat, edges, nodes, raw, depth - 1, rate, bins, least, ridge)
    left, right = _grow(rows[low], *args), _grow(rows[~low], *args)
    nodes[me][:4] = [f, float(edges[f][b]), left, right]
    return me


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, column: str = "quality") -> Trees:
    """Fit on at most `sample` labelled rows, those with the least hashes of doc_id, and never on held-out ones.

    docs (doc_id, text), labels (doc_id, quality 0/1). Null ids or labels teach nothing; equal rows count as often as they stand there, within the sample.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y")).where("doc_id is not null and y in (0, 1)")
    picked = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most `sample` rows of two numbers: far below any limit of a broadcast.
    joined = texts.join(F.broadcast(picked), "doc_id").select("y", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["y", "doc_id", "x"])

    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("y"), F.xxhash64("x"))
    rows = joined.mapInArrow(run, "y double, doc_id long, x array<double>").orderBy(*order).limit(sample).collect()
    return fit_trees(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["y"] for r in rows]))


def _scores(texts: pa.Array, trees: Trees) -> np.ndarray:
    if not len(texts):
        return np.zeros(0)
    return trees.score(np.array([features(t.as_py()) for t in texts]))


def score(docs: DataFrame, trees: Trees, limit: float = 0.7) -> DataFrame:
    """doc_id, score, predicted (1 from `limit` on) for each row of docs (doc_id, text).

    A null text counts as an empty one, and both are scored. Null doc_ids stay null, equal rows score equally, no rows give none, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(batch.column(1), trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= limit).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, trees: Trees, limit: float = 0.7) -> DataFrame:
    """The rows of docs that score `limit` or more, with all their columns. Only texts go to Python; the rows stay where they are."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(_scores(texts, trees), pa.float64())

    return docs.where(scored(F.col("text").cast("string")) >= limit)
