"""Quality rules on repeated word sequences, by suffix arrays.

The suffixes of many documents are sorted at once by prefix doubling, each document's on their own. Neighbours in that order share the longest prefixes:
a suffix lies in longest-common-prefix intervals, the deepest of which is the longest repeat that starts there. The spans of all repeats of
`least` words or more are united; their share of the words and the longest repeat are limited.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words sorted at once; a longer document is sorted alone.
BLOCK = 1 << 19
OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, n_maximal_repeats long, base_failed boolean, kept boolean"


def _rank(key: np.ndarray, base: np.ndarray | int) -> np.ndarray:
    """For each key the place of the first equal one in sorted order, added to base."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(first, np.diff(np.append(first, len(k))))
    return out + base


def suffix_ranks(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of words (ids with equal ids only in one document), and the ranks by the first 1, 2, 4 ... words.

    ends[i]: where the document of word i ends. A rank is the place of the first suffix with that prefix.
    """
    n = len(words)
    rank = _rank(words, 0)
    levels, width = [rank.astype(np.int32)], 1
    size = np.bincount(rank, minlength=n)
    left = np.flatnonzero(size[rank] > 1)
    while len(left):
        beyond = left + width
        nxt = np.where(beyond < ends[left], rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[left] * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        k, r = key[order], rank[left][order]
        new_group = np.concatenate([[True], r[1:] != r[:-1]])
        new_key = np.concatenate([[True], k[1:] != k[:-1]])
        at = np.arange(len(k))
        start = np.maximum.accumulate(np.where(new_group, at, 0))
        first = np.maximum.accumulate(np.where(new_key, at, 0))
        rank = rank.copy()
        rank[left[order]] = r + first - start
        levels.append(rank.astype(np.int32))
        counts = np.diff(np.append(np.flatnonzero(new_key), len(k)))
        alone = np.repeat(counts == 1, counts)
        left = np.sort(left[order][~alone])
        width *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    return array, levels


def common_prefixes(array: np.ndarray, levels: list[np.ndarray], ends: np.ndarray, least: int) -> np.ndarray:
    """Words that each suffix in the array shares with the one before it; 0 where fewer than `least`."""
    out = np.zeros(len(array), np.int64)
    if len(array) < 2:
        return out
    floor = max(0, least.bit_length() - 1)
    if floor >= len(levels):
        return out
    a, b = array[:-1], array[1:]
    at = np.flatnonzero(levels[floor][a] == levels[floor][b])
    i, j, total = a[at].copy(), b[at].copy(), np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        open_ = (i < ends[a[at]]) & (j < ends[b[at]])
        same = open_ & (levels[k][np.minimum(i, len(array) - 1)] == levels[k][np.minimum(j, len(array) - 1)])
        step = same * (1 << k)
        i, j, total = i + step, j + step, total + step
    out[at + 1] = np.where(total >= least, total, 0)
    return out


def _maximal(array: np.ndarray, lcp: np.ndarray, words: np.ndarray, starts: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """How many longest-common-prefix intervals of each document can't be extended to the left either: its maximal repeats."""
    out = np.zeros(n_docs, np.int64)
    before = np.where(array > starts[array], words[np.maximum(array - 1, 0)], -1 - array)  # a document's first word follows nothing
    stack: list[list[int]] = []  # open intervals: length, left word or -1 if several
    live = np.flatnonzero((lcp > 0) | np.append(lcp[1:] > 0, False)).tolist()
    several, last = -(1 << 62), -2
    for p in live + [-1]:
        level = int(lcp[p]) if p >= 0 and p == last + 1 else 0
        carry = None
        while stack and stack[-1][0] > level:
            _, left, d = stack.pop()
            if left == several:
                out[d] += 1
            if stack and stack[-1][0] >= level:
                if stack[-1][1] != left:
                    stack[-1][1] = several
            else:
                carry = left
        if p < 0:
            break
        w = int(before[p])
        if level:
            if not stack or stack[-1][0] < level:
                stack.append([level, int(before[p - 1]) if carry is None else carry, int(doc[array[p]])])
            if stack[-1][1] != w:
                stack[-1][1] = several
            deeper = int(lcp[p + 1]) if p + 1 < len(lcp) else 0
            if deeper > level:
                last = p
                continue
        last = p
    return out


def repeats(texts: list[list[bytes]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document, words under repeats of `least` words or more, the longest repeat, and the number of maximal repeats."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    covered, longest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if not n:
        return covered, longest, covered.copy()
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    flat = np.fromiter((ids[w] for t in texts for w in t), np.int64, n)
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)[doc]
    words = doc * len(ids) + flat
    array, levels = suffix_ranks(words, ends)
    lcp = common_prefixes(array, levels, ends, least)
    reach = np.zeros(n, np.int64)  # the longest repeat that starts at each word
    reach[array] = np.maximum(lcp, np.append(lcp[1:], 0))
    at = np.flatnonzero(reach)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + reach[at], -1)
    np.add.at(covered, doc, np.cumsum(edge[:-1]) > 0)
    np.maximum.at(longest, doc, reach)
    return covered, longest, _maximal(array, lcp, words, ends - sizes[doc], doc, len(texts))


def _duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").split()]
    return len(lines) - len(set(lines))


def judge(texts: list[str], least: int, max_covered: float, max_longest: int) -> list[tuple]:
    """OUT without doc_id, for each text."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    covered, longest, maximal = repeats(split, least)
    out = []
    for t, w, c, l, m in zip(texts, split, covered.tolist(), longest.tolist(), maximal.tolist()):
        n = len(w)
        failed = n < 20 or 100 * c > 30 * n
        kept = not failed and c <= max_covered * n and l <= max_longest
        out.append((n, len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")), sum(map(t.count, "#*$%&|<>")), _duplicate_lines(t), c, l, m, failed, kept))
    return out


def repetition_rules(docs: DataFrame, least: int = 8, max_covered: float = 0.3, max_longest: int = 60) -> DataFrame:
    """OUT for each row of docs (doc_id, text): counts over the whole text, and whether it is kept.

    n_repeat_words: words under sequences of `least` words or more that the text has twice or more, the first included. base_failed: fewer than 20 words, or more than 30%
    under repeats. kept: not base_failed, at most max_covered of the words under repeats, and no repeat longer than max_longest. A null text is an empty one;
    null doc_ids stay null, equal rows get equal results, no rows give none, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, size, texts = 0, 0, []
            for i, t in enumerate(batch.column(1)):
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size > 6 * BLOCK or i == len(batch) - 1:
                    columns = zip(*judge(texts, least, max_covered, max_longest))
                    kinds = [pa.int64()] * 7 + [pa.bool_()] * 2
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[x.split()[0] for x in OUT.split(", ")])
                    lo, size, texts = i + 1, 0, []

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)
