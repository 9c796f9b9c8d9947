"""Removal of word sequences that an earlier document has, by super-k-mer partitioning.

Each window of k words has a minimiser: the least hash of its m-word grams. Consecutive windows with the same minimiser travel as one
packed string to the minimiser's bucket, so equal windows meet there, and sorting counts them. Equal hashes are compared byte by byte.

The number of buckets follows the bytes of the input, and all strings are counted first. A bucket that a common minimiser fills beyond its bound is split by a
second minimiser, the least of the grams under another hash; strings are cut where that changes. Only where windows with both minimisers in common still
fill more than a bucket, which takes passages repeated as often, they go as rows of hashes that are summed up before they are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.llm.rolling import mix, split_words, word_hashes
from seamline.operators.skew import join_counted
from seamline.workspace import Workspace

#: Text bytes worked on at once, and packed bytes gathered before they are sent.
CHUNK, FLUSH = 2 << 20, 24 << 20
#: Packed bytes for each byte of text, about; the mean bucket is a quarter of the largest.
PACKED, SLACK = 3.5, 4
#: Buckets that are split, and parts of them that are too large, at most: a bucket counts as too large from this part of all bytes on, if that is more than its bound.
MOST = 1 << 20
BLOBS = "bucket long, blob binary"
SPANS = "doc_id long, th long, start int, end int"


@dataclass
class Layout:
    """Where windows go: buckets, those that are split (ascending) with their parts, and destinations that go as rows (ascending)."""

    buckets: int
    split: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def bucket(self, minimiser: np.ndarray) -> np.ndarray:
        return (mix(minimiser) % np.uint64(self.buckets)).astype(np.int64)

    def parts_of(self, bucket: np.ndarray) -> np.ndarray:
        """How many parts each bucket has; 1: it isn't split."""
        if not len(self.split):
            return np.ones(len(bucket), np.int64)
        at = np.minimum(np.searchsorted(self.split, bucket), len(self.split) - 1)
        return np.where(self.split[at] == bucket, self.parts[at], 1)

    def as_rows(self, destination: np.ndarray) -> np.ndarray:
        return np.isin(destination, self.rows)


def _least(g: np.ndarray, n: int, span: int) -> np.ndarray:
    """The least of each `span` neighbours."""
    wide = 1
    while 2 * wide <= span:
        g = np.minimum(g[: len(g) - wide], g[wide:])
        wide *= 2
    return np.minimum(g[:n], g[span - wide : span - wide + n])


class Runs:
    """The super-k-mers of a chunk of documents."""

    def __init__(self, texts: list[bytes], k: int, m: int, layout: Layout):
        self.buf = np.frombuffer(b"".join(b" ".join(t.split()) + b"\n" for t in texts), np.uint8)
        self.starts, self.ends, record = split_words(self.buf)
        w = word_hashes(self.buf, self.starts, self.ends)
        n = max(0, len(w) - k + 1)
        self.first = self.last = self.bucket = self.destination = self.doc = self.word = np.zeros(0, np.int64)
        if not n:
            return
        grams = len(w) - m + 1
        with np.errstate(over="ignore"):
            g = np.zeros(grams, np.uint64)
            for j in range(m):
                g = g * np.uint64(0x9FB21C651E98DF25) + w[j : j + grams]
        g = mix(g)
        low, span = _least(g, n, k - m + 1), k - m + 1
        valid = record[:n] == record[k - 1 : k - 1 + n]
        same = np.zeros(n, bool)
        same[1:] = valid[1:] & valid[:-1] & (low[1:] == low[:-1]) & (record[1:n] == record[: n - 1])
        bucket = layout.bucket(low)
        parts = layout.parts_of(bucket)
        second = np.zeros(n, np.uint64)
        if (parts > 1).any():
            other = _least(mix(g ^ np.uint64(0x5851F42D4C957F2D)), n, span)
            second = np.where(parts > 1, other, second)
            same[1:] &= second[1:] == second[:-1]
        self.first = np.flatnonzero(valid & ~same)
        follows = np.append(same[1:], False)
        self.last = np.flatnonzero(valid & ~follows) + k - 1  # the last word of the last window
        self.bucket = bucket[self.first]
        self.destination = self.bucket * MOST + (mix(second[self.first]) % parts[self.first].astype(np.uint64)).astype(np.int64)
        self.doc = record[self.first]
        counts = np.bincount(record, minlength=len(texts))
        self.word = self.first - (np.cumsum(counts) - counts)[self.doc]  # the first word's place in its document

    def size(self) -> np.ndarray:
        """Packed bytes of each."""
        return self.ends[self.last] - self.starts[self.first] + 20


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch by chunks, with the place of the first."""
    at, texts, size = 0, [], 0
    for i, t in enumerate(batch.column(2)):
        texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(texts[-1])
        if size > CHUNK:
            yield at, texts
            at, texts, size = i + 1, [], 0
    if texts:
        yield at, texts


def _too_large(docs: DataFrame, k: int, m: int, layout: Layout, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Destinations with more than `bound` packed bytes over all of docs (doc_id, th, text), and their bytes; of split buckets only, if there are any."""
    held = docs.sparkSession.sparkContext.broadcast(layout)  # at most MOST buckets

    def run(batches):
        layout = held.value
        for batch in batches:
            for _, texts in _chunks(batch):
                r = Runs(texts, k, m, layout)
                mine = layout.parts_of(r.bucket) > 1 if len(layout.split) else np.ones(len(r.first), bool)
                at, nth = np.unique(r.destination[mine], return_inverse=True)
                n = np.bincount(nth, weights=r.size()[mine], minlength=len(at)) if len(at) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], names=["at", "n"])

    found = docs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") > bound).orderBy("at").collect()  # at most MOST rows
    return np.array([r["at"] for r in found], np.int64), np.array([r["n"] for r in found], np.int64)


def plan(docs: DataFrame, k: int, m: int, bucket_bytes: int) -> tuple[Layout, int]:
    """The layout for docs (doc_id, th, text), and about how many packed bytes there are."""
    total = int(PACKED * (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)) + 1
    layout, bound = Layout(max(1, -(-SLACK * total // bucket_bytes))), max(bucket_bytes, -(-total // MOST))
    at, n = _too_large(docs, k, m, layout, bound)
    if len(at):
        layout = Layout(layout.buckets, at // MOST, np.minimum(MOST, -(-SLACK * n // bound)))
        layout.rows = _too_large(docs, k, m, layout, bound)[0]
    return layout, total


def _pack(docs: DataFrame, k: int, m: int, layout: Layout) -> DataFrame:
    held_layout = docs.sparkSession.sparkContext.broadcast(layout)  # at most MOST buckets

    def run(batches):
        import zstandard

        press, layout = zstandard.ZstdCompressor(level=3), held_layout.value
        held: dict[int, list[tuple[np.ndarray, bytes]]] = {}
        size = 0

        def flush():
            for b, parts in sorted(held.items()):
                heads = np.concatenate([h for h, _ in parts], axis=1)
                data = heads.shape[1].to_bytes(8, "little") + heads.tobytes() + b"".join(p for _, p in parts)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([press.compress(data)])], names=["bucket", "blob"])
            held.clear()

        for batch in batches:
            ids, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for at, texts in _chunks(batch):
                r = Runs(texts, k, m, layout)
                b = r.destination
                order = np.argsort(b, kind="stable")
                order = order[~layout.as_rows(b[order])]
                if not len(order):
                    continue
                view = memoryview(r.buf)
                heads = np.stack([ids[at + r.doc[order]], th[at + r.doc[order]], r.word[order]])
                lo, hi = r.starts[r.first[order]], r.ends[r.last[order]] + 1
                strings = list(map(view.__getitem__, map(slice, lo.tolist(), hi.tolist())))
                cuts = np.flatnonzero(np.diff(b[order], prepend=-2)).tolist() + [len(order)]
                for x, y in zip(cuts, cuts[1:]):
                    # a record ends in the blank or line feed after its last word; made a line feed when read
                    part = bytearray(b"".join(strings[x:y]))
                    ends = np.cumsum(hi[x:y] - lo[x:y]) - 1
                    np.frombuffer(part, np.uint8)[ends] = 10
                    held.setdefault(int(b[order[x]]), []).append((heads[:, x:y], bytes(part)))
                    size += len(part) + 24 * (y - x)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(run, BLOBS)


def repeated_spans(blobs: list[bytes], k: int) -> tuple[np.ndarray, ...]:
    """doc_id, th, start, end (words) of the runs of windows that also stand in a document with a smaller doc_id, from one bucket's strings."""
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    heads, texts, hashes, owners, words, offsets, lengths = [], [], [], [], [], [], []
    base = records = 0
    for blob in blobs:
        data = open_.decompress(blob)
        n = int.from_bytes(data[:8], "little")
        heads.append(np.frombuffer(data, np.int64, 3 * n, 8).reshape(3, n))
        text = data[8 + 24 * n :]
        buf = np.frombuffer(text, np.uint8)
        starts, ends, record = split_words(buf)
        w = word_hashes(buf, starts, ends)
        count = len(w) - k + 1
        with np.errstate(over="ignore"):
            h = np.zeros(count, np.uint64)
            for j in range(k):
                h = h * np.uint64(0x9FB21C651E98DF25) + w[j : j + count]
        at = np.flatnonzero(record[:count] == record[k - 1 :])
        nth = np.bincount(record, minlength=n)
        hashes.append(h[at])
        owners.append(record[at] + records)
        words.append(at - (np.cumsum(nth) - nth)[record[at]])
        offsets.append(starts[at] + base)
        lengths.append((ends[at + k - 1] - starts[at]).astype(np.int32))
        texts.append(text)
        base += len(text)
        records += n
    head, h, owner, word = np.concatenate(heads, axis=1), np.concatenate(hashes), np.concatenate(owners), np.concatenate(words)
    offset, length, text = np.concatenate(offsets), np.concatenate(lengths), b"".join(texts)
    doc = head[0][owner]
    order = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
    least = np.minimum.reduceat(doc[order], new)
    group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    low = least[group]
    _settle_collisions(order, group, new, low, doc, offset, length, text)
    hit = np.zeros(len(h), bool)
    hit[order] = doc[order] > low
    # runs of neighbouring windows of one record
    joined = np.zeros(len(h), bool)
    joined[1:] = hit[1:] & hit[:-1] & (owner[1:] == owner[:-1])
    first = np.flatnonzero(hit & ~joined)
    last = np.flatnonzero(hit & ~np.append(joined[1:], False))
    o = owner[first]
    return head[0][o], head[1][o], (head[2][o] + word[first]).astype(np.int32), (head[2][o] + word[last] + k).astype(np.int32)


def _settle_collisions(order, group, new, low, doc, offset, length, text) -> None:
    """Where different windows share a hash, take the least document of each window on its own. Only groups of two documents matter."""
    sizes = np.diff(np.append(new, len(order)))
    many = np.flatnonzero((sizes > 1)[group] & (low != np.maximum.reduceat(doc[order], new)[group]))
    bad = set()
    starts, sizes_ = offset[order], length[order]
    firsts = new[group[many]]
    for i, f, s, n, s0, n0 in zip(many.tolist(), firsts.tolist(), starts[many].tolist(), sizes_[many].tolist(), starts[firsts].tolist(), sizes_[firsts].tolist()):
        if n != n0 or text[s : s + n] != text[s0 : s0 + n0]:
            bad.add(int(group[i]))
    for g in bad:
        members = range(new[g], new[g] + sizes[g])
        window = {i: text[starts[i] : starts[i] + sizes_[i]] for i in members}
        least: dict[bytes, int] = {}
        for i in members:
            d = int(doc[order[i]])
            least[window[i]] = min(d, least.get(window[i], d))
        for i in members:
            low[i] = least[window[i]]


def _count_buckets(packed: DataFrame, k: int, tasks: int) -> DataFrame:
    def run(batches):
        now, blobs = None, []

        def out():
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in repeated_spans(blobs, k)], names=["doc_id", "th", "start", "end"])

        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != now:
                    yield from out()
                    now, blobs = b, []
                blobs.append(blob.as_py())
        yield from out()

    return packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, SPANS)


def _count_rows(docs: DataFrame, k: int, m: int, layout: Layout, work: Workspace) -> DataFrame:
    """Spans for the destinations that are too large: their windows as rows of 128-bit hashes, summed up where they are made, then joined back."""
    held_layout = docs.sparkSession.sparkContext.broadcast(layout)  # at most MOST buckets

    def run(batches):
        import xxhash

        layout, held = held_layout.value, []

        def out():
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=["window", "doc_id", "th", "start"])

        for batch in batches:
            ids, th = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, texts in _chunks(batch):
                r = Runs(texts, k, m, layout)
                view = memoryview(r.buf)
                for i in np.flatnonzero(layout.as_rows(r.destination)).tolist():
                    first, doc, word = int(r.first[i]), at + int(r.doc[i]), int(r.word[i])
                    lo, hi = r.starts[first : int(r.last[i]) - k + 2].tolist(), r.ends[first + k - 1 : int(r.last[i]) + 1].tolist()
                    held += [(xxhash.xxh3_128_digest(view[a:b]), ids[doc], th[doc], word + j) for j, (a, b) in enumerate(zip(lo, hi))]
                    if len(held) > 20_000:
                        yield out()
                        held = []
        if held:
            yield out()

    rows = work.keep(docs.mapInArrow(run, "window binary, doc_id long, th long, start int"), "rows")
    least = work.keep(rows.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").drop("high"), "least")
    return join_counted(rows, least, "window", rows.count()).where("doc_id > low").select("doc_id", "th", "start", (F.col("start") + k).cast("int").alias("end"))


KEPT = "n_words long, n_removed long, kept string"


def _keep_words(text: str | None, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    gone = np.zeros(len(words) + 1, np.int64)
    for s, e in spans:
        gone[s] += 1
        gone[e] -= 1
    kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g] if spans else words
    return len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, k: int = 13, m: int = 3, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for each row of docs (doc_id, text).

    A word goes if a window of k words over it also starts in a document with a smaller doc_id; windows are judged on the input. Fewer than k words:
    nothing goes. A null text has no words. A null doc_id is neither smaller nor larger than another: its row loses nothing and takes nothing away.
    Rows of one doc_id don't take from each other; equal rows lose the same. No rows: none. Other columns are ignored.

    `bucket_bytes` bounds the strings sorted together. What fills a bucket by itself is split, and passages that are repeated so often that no split helps go as rows (see above);
    the result is the same either way.
    """
    work = Workspace(docs.sparkSession, "substring")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    known = base.where("doc_id is not null and text is not null")
    layout, total = plan(known, k, m, bucket_bytes)
    spans = _count_buckets(_pack(known, k, m, layout), k, max(1, total // (3 * bucket_bytes)))
    if len(layout.rows):
        spans = spans.union(_count_rows(known, k, m, layout, work))
    spans = work.keep(spans, "spans")
    work.drop("rows", "least")
    merged = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    # The spans of few documents are looked up for many: the texts aren't sorted.
    joined = base.join(merged.hint("shuffle_hash"), ["doc_id", "th"], "left").select("doc_id", "text", "spans.start", "spans.end")

    def run(batches):
        for batch in batches:
            out = []
            for text, s, e in zip(batch.column(1), batch.column(2), batch.column(3)):
                out.append(_keep_words(text.as_py(), list(zip(s.as_py() or (), e.as_py() or ()))))
            n, r, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"doc_id long, {KEPT}")
