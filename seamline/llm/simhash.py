"""SimHash near-duplicates by the generalised pigeonhole principle.

Equal fingerprints are one node. The 64 bits of the distinct fingerprints are grouped into parts of correlated bits. Each fingerprint
gives each part a threshold of its own: thresholds t with sum(t + 1) = distance + 1 can't all be exceeded by a fingerprint within the
distance, and dynamic programming picks those for which the fewest candidates are expected. Candidates of a bucket are verified in
blocks, and a block passes on a spanning forest instead of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from seamline.llm.rolling import mix, split_words, word_hashes
from seamline.operators.components import LINKS, connected_components, forest
from seamline.operators.skew import join_counted
from seamline.workspace import Workspace

BITS = 64
#: Members of a bucket, and rows that probe it, that meet in one cell. A value of a part held by so many fingerprints, or by a thousandth of them if that is more, is noted as heavy when thresholds are priced.
HEAVY = 8192
#: Rows for the buckets sent at once.
ROWS = 1 << 18
#: What a row in a bucket costs, in pairs verified: it is made, dealt out and sorted.
ROW_COST = 40.0
#: Pairs verified at once.
PAIRS = 1 << 18


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash; zero for a text without words. Each of the shingles counts, repeated ones too."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle))))
    ones, n = np.zeros(BITS, np.int64), 0
    while len(h := np.fromiter(map(xxhash.xxh64_intdigest, islice(shingles, 1 << 15), repeat(42)), np.uint64)):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, th, fp: a hash of each row's whole text and its fingerprint, as a signed long with the same bits. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "th", "fp"])

    return _hashed(docs).mapInArrow(run, "doc_id long, th long, fp long")


def text_hash(text: Column) -> Column:
    """A hash of the whole text; a null one is empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("th"), text.alias("text"))


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _fps(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)


def correlated_parts(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The 64 bits in m parts of about equal width, correlated bits together. both[i, j]: fingerprints with bits i and j set."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    r = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(r, 0)
    left, parts = set(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        pool = sorted(left)
        part = [max(pool, key=lambda i: (r[i, pool].sum(), -i))]
        while len(part) < width:
            part.append(max((i for i in pool if i not in part), key=lambda i: (r[i, part].sum(), -i)))
        left -= set(part)
        parts.append(sorted(part))
    return parts


def part_values(fp: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of a part, gathered into the low bits of a number."""
    out = np.zeros(len(fp), np.uint64)
    for k, bit in enumerate(part):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, e) for e in range(radius + 1))


class Thresholds:
    """Per-part thresholds of each fingerprint, by dynamic programming over expected candidates.

    The expected number within a radius comes from exact counts of every byte of every part over all fingerprints, with the bytes taken as independent;
    a heavy value's own count is known and replaces a lower estimate. Both only steer the cost; any thresholds find all links.
    """

    def __init__(self, parts: list[list[int]], counts: dict[tuple[int, int], np.ndarray], n: int, heavy: list[dict[int, int]], distance: int):
        self.parts, self.n, self.heavy, self.distance = parts, n, heavy, distance
        pop = np.array([bin(v).count("1") for v in range(256)])
        near = pop[np.arange(256)[:, None] ^ np.arange(256)]
        self.tables = {}
        for key, c in counts.items():
            share = c / max(c.sum(), 1)
            self.tables[key] = np.stack([(near == d) @ share for d in range(distance + 1)], axis=1)  # value, distance -> share
        self.heavy_values = [np.array(sorted(h), np.uint64) for h in heavy]
        self.heavy_counts = [np.array([h[v] for v in sorted(h)], float) for h in heavy]

    def expected(self, k: int, values: np.ndarray) -> np.ndarray:
        """Candidates within radius 0 .. distance of the values in part k."""
        total = np.zeros((len(values), self.distance + 1))
        total[:, 0] = 1
        for c in range(-(-len(self.parts[k]) // 8)):
            t = self.tables[k, c][(values >> np.uint64(8 * c)).astype(np.int64) & 255]
            total = np.stack([sum(total[:, i] * t[:, d - i] for i in range(d + 1)) for d in range(self.distance + 1)], axis=1)
        out = np.cumsum(total, axis=1) * self.n
        if len(self.heavy_values[k]):
            at = np.clip(np.searchsorted(self.heavy_values[k], values), 0, len(self.heavy_values[k]) - 1)
            known = np.where(self.heavy_values[k][at] == values, self.heavy_counts[k][at], 0)
            out = np.maximum(out, known[:, None])
        return out

    def choose(self, values: list[np.ndarray], row_cost: float = ROW_COST) -> np.ndarray:
        """Units (threshold + 1) of each part for each fingerprint; a row costs as much as row_cost candidates."""
        units, m = self.distance + 1, len(self.parts)
        best, picks = None, []
        for k in range(m):
            cost = np.zeros((len(values[k]), units + 1))
            cost[:, 1:] = self.expected(k, values[k]) + row_cost * np.array([_ball(len(self.parts[k]), e) for e in range(units)])
            if best is None:
                best, pick = cost, np.tile(np.arange(units + 1), (len(cost), 1))
            else:
                options = np.stack([np.stack([best[:, u - x] + cost[:, x] if x <= u else np.full(len(cost), np.inf) for x in range(units + 1)]) for u in range(units + 1)])
                pick, best = options.argmin(axis=1).T, options.min(axis=1).T
            picks.append(pick)
        out, left, rows = np.zeros((m, len(values[0])), np.int64), np.full(len(values[0]), units), np.arange(len(values[0]))
        for k in range(m - 1, -1, -1):
            out[k] = picks[k][rows, left]
            left -= out[k]
        return out


def choose_parts(n: int, distance: int) -> int:
    """How many parts cost least if bits were even: rows to shuffle against candidates to verify."""

    def cost(m: int) -> float:
        width, units = BITS // m, [(distance + 1) // m + (i < (distance + 1) % m) for i in range(m)]
        balls = [_ball(width, u - 1) for u in units if u]
        return sum(ROW_COST * b + b * n / 2.0**width for b in balls) + ROW_COST * m

    return min(range(1 if distance == 0 else 2, distance + 2), key=cost)


def _partial(fps: DataFrame, run, schema: str) -> DataFrame:
    return fps.select("fp").mapInArrow(run, schema)


def _pair_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set."""

    def run(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            x = _bits(_fps(batch)).astype(np.float64)
            total += (x.T @ x).astype(np.int64)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    for i, j, n in _partial(fps, run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n")).collect():  # at most 64 * 64 rows
        out[i, j] = n
    return out


def _byte_counts(fps: DataFrame, parts: list[list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """For each byte of each part, how many fingerprints have each of its values."""
    keys = [(k, c) for k, part in enumerate(parts) for c in range(-(-len(part) // 8))]

    def run(batches):
        total = np.zeros((len(keys), 256), np.int64)
        for batch in batches:
            fp = _fps(batch)
            values = [part_values(fp, p) for p in parts]
            for x, (k, c) in enumerate(keys):
                total[x] += np.bincount((values[k] >> np.uint64(8 * c)).astype(np.int64) & 255, minlength=256)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "n"])

    out = {key: np.zeros(256) for key in keys}
    for i, j, n in _partial(fps, run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n")).collect():  # at most 11 * 256 rows
        out[keys[i]][j] = n
    return out


def _heavy_values(fps: DataFrame, parts: list[list[int]], n: int) -> list[dict[int, int]]:
    """Values held by many fingerprints: at most a thousand for each part."""
    at_least = max(HEAVY, -(-n // 1000))

    def run(batches):
        for batch in batches:
            fp = _fps(batch)
            for k, part in enumerate(parts):
                v, c = np.unique(part_values(fp, part), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k)), pa.array(v.view(np.int64)), pa.array(c)], names=["k", "v", "n"])

    out: list[dict[int, int]] = [{} for _ in parts]
    if n < at_least:
        return out
    for k, v, c in _partial(fps, run, "k long, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least).collect():
        out[k][v] = c
    return out


ENTRIES = "part int, value long, fp long, kind byte"


def _entries(fps: DataFrame, thresholds: Thresholds) -> DataFrame:
    """Rows for the buckets: each fingerprint is a member of its value's bucket in each part (kind 1) and probes the values within its threshold (kind 2; both: 3)."""
    parts = thresholds.parts

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                fp = _fps(batch.slice(lo, 4096))
                values = [part_values(fp, p) for p in parts]
                units = thresholds.choose(values)
                for k, part in enumerate(parts):
                    held, n = [(values[k], fp, np.where(units[k] > 0, 3, 1).astype(np.int8))], len(fp)

                    def out():
                        value, owner, kind = (np.concatenate(x) for x in zip(*held))
                        return pa.RecordBatch.from_arrays([pa.array(np.full(len(value), k, np.int32)), pa.array(value.view(np.int64)), pa.array(owner.view(np.int64)), pa.array(kind)], names=["part", "value", "fp", "kind"])

                    for e in range(1, int(units[k].max(initial=0))):
                        far = units[k] > e
                        v, f, two = values[k][far], fp[far], np.full(int(far.sum()), 2, np.int8)
                        for bits in combinations(range(len(part)), e):
                            held.append((v ^ np.uint64(sum(1 << b for b in bits)), f, two))
                            n += len(f)
                            if n > ROWS:
                                yield out()
                                held, n = [], 0
                    if held:
                        yield out()

    return fps.select("fp").mapInArrow(run, ENTRIES)


def _dealt(entries: DataFrame, work: Workspace) -> DataFrame:
    """entries with the cell of their bucket. A bucket of more than HEAVY members or probing rows is a grid: members lie along one axis, those that probe along the other,
    so a cell has about HEAVY of each at most, however many rows share a value."""
    member, probe = F.col("kind").bitwiseAND(1) > 0, F.col("kind").bitwiseAND(2) > 0
    sizes = entries.groupBy("part", "value").agg(F.count_if(member).alias("members"), F.count_if(probe).alias("probes")).where(f"members > 0 and greatest(members, probes) > {HEAVY}")
    grids = work.keep(sizes.select("part", "value", *(F.greatest(F.lit(1), F.ceil(F.col(c) / HEAVY)).cast("int").alias(a) for a, c in (("m", "members"), ("p", "probes")))), "grids")
    whole = entries.withColumn("cell", F.lit(0))
    if not grids.limit(1).collect():
        return whole
    split = entries.join(grids, ["part", "value"])  # Spark broadcasts the table of grids if it is small, and splits a key that isn't
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    place = lambda kind, at: F.struct(F.lit(kind).cast("byte").alias("kind"), at.cast("int").alias("cell"))
    none = F.array().cast("array<struct<kind:tinyint,cell:int>>")
    along = F.when(member, F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda x: place(1, own("m") * F.col("p") + x))).otherwise(none)
    across = F.when(probe, F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda x: place(2, x * F.col("p") + own("p")))).otherwise(none)
    cells = split.select("part", "value", "fp", F.explode(F.concat(along, across)).alias("x")).select("part", "value", "fp", "x.kind", "x.cell")
    return entries.join(grids, ["part", "value"], "left_anti").withColumn("cell", F.lit(0)).unionByName(cells)


def _verified(distance: int):
    """Links of the buckets that come sorted by bucket and fingerprint: each probing row against the bucket's members before it, of which only those are held."""

    def links(key: np.ndarray, fp: np.ndarray, kind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        first = np.repeat(new, np.diff(np.append(new, len(key))))
        members = np.flatnonzero((kind & 1) > 0)
        before = np.concatenate([[0], np.cumsum((kind & 1) > 0)])  # members before each row
        probing = np.flatnonzero((kind & 2) > 0)
        start = before[first[probing]]
        counts = before[probing] - start
        busy = counts > 0
        probing, start, counts = probing[busy], start[busy], counts[busy]
        ends = np.cumsum(counts)
        lo = 0
        while lo < len(probing):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            n = counts[lo:hi]
            j = np.repeat(probing[lo:hi], n)
            i = members[np.repeat(start[lo:hi], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            near = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & (fp[i] != fp[j])
            if near.any():
                yield forest(fp[i[near]].view(np.int64), fp[j[near]].view(np.int64))
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_fp = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # the members of a bucket that may go on
        for batch in batches:
            part, value, cell, fp, kind = (np.asarray(batch.column(i)) for i in range(5))
            with np.errstate(over="ignore"):
                key = value.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + cell.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
            key, fp, kind = np.concatenate([open_key, key]), np.concatenate([open_fp, fp.astype(np.int64).view(np.uint64)]), np.concatenate([np.ones(len(open_key), np.int8), kind])
            for a, b in links(key, fp, kind):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            last = (key == key[-1:]) & ((kind & 1) > 0) if len(key) else np.zeros(0, bool)
            open_key, open_fp = key[last], fp[last]

    return run


def near_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links a, b that join the same fingerprints as all pairs within the distance do. fps: a table of distinct fingerprints fp."""
    work = Workspace(fps.sparkSession, "near")
    n = fps.count()
    parts = correlated_parts(_pair_counts(fps), n, choose_parts(n, distance))
    thresholds = Thresholds(parts, _byte_counts(fps, parts), n, _heavy_values(fps, parts, n), distance)
    entries = work.keep(_entries(fps, thresholds), "entries")  # carries the tables: byte counts and at most a thousand heavy values for each part
    bucketed = _dealt(entries, work).select("part", "value", "cell", "fp", "kind").repartition("part", "value", "cell").sortWithinPartitions("part", "value", "cell", "fp")
    return bucketed.mapInArrow(_verified(distance), LINKS)


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text): the smallest doc_id reachable over links of `distance` or fewer bits.

    Null and empty texts have fingerprint zero and link like any other. A null doc_id belongs to its component but never names it
    (component_id is null if no doc_id does). Repeated rows come back as often. No rows: none. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "simhash")
    marked = work.keep(fingerprints(docs, shingle), "fingerprints")
    nodes = work.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("root"), F.count("*").alias("n")), "nodes")
    labels = work.keep(connected_components(near_links(nodes.select("fp"), distance), contracted=True), "labels")
    return join_counted(marked, _named(nodes, labels, "fp", work), "fp", marked.count()).select("doc_id", "fp", "component_id")


def _named(nodes: DataFrame, labels: DataFrame, key: str, work: Workspace) -> DataFrame:
    """key, label, component_id, n for nodes (key, root, n) and the labels of those that have links. Neither a component of most nodes nor a key of most rows is a hot key of a join."""
    joined = labels.select(F.col("node").alias(key), "label").union(labels.select(F.col("label").alias(key), "label")).distinct()
    # Only nodes with links need another root than their own.
    linked = work.keep(joined.join(nodes, key), "linked")
    roots = work.keep(linked.groupBy("label").agg(F.min("root").alias("component_id"), F.count("*").alias("members")), "roots")
    together = join_counted(linked, roots, "label", linked.count(), "members").select(key, "label", "component_id", "n")
    alone = nodes.join(joined.select(key), key, "left_anti").select(key, F.col(key).alias("label"), F.col("root").alias("component_id"), "n")
    return work.keep(together.union(alone), "components")


#: Shingles, and texts, that a side of a cell of texts to compare has, about; a group with more of either is large. 4096 one-shingle texts against as many take about two seconds.
CELL, TEXTS = 1 << 19, 4096


#: Bytes of text hashed at once.
CHUNK = 1 << 20


def hashed_sets(texts: Iterable[str | None], shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct words and its distinct shingles of `shingle` words (A-Z in lower case) as sorted 64-bit hashes; fewer words are one shingle, none have none.

    Words are hashed for many texts at once, and a shingle's hash comes from those of its words.
    """
    held, size = [], 0

    def done() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        buf = np.frombuffer(b"".join(b" ".join(t.split()) + b"\n" for t in held), np.uint8)
        starts, ends, record = split_words(buf)
        w = word_hashes(buf, starts, ends)
        with np.errstate(over="ignore"):
            g = np.zeros(max(0, len(w) - shingle + 1), np.uint64)
            for j in range(shingle):
                g = g * np.uint64(0x9FB21C651E98DF25) + w[j : j + len(g)]
        g = mix(g)
        bounds = np.searchsorted(record, np.arange(len(held) + 1))
        for lo, hi in zip(bounds.tolist(), bounds[1:].tolist()):
            words = w[lo:hi]
            if hi - lo >= shingle:
                yield np.unique(words), np.unique(g[lo : hi - shingle + 1])
            elif hi > lo:
                whole = 0
                for x in words.tolist():
                    whole = (whole * 0x9FB21C651E98DF25 + x + 1) & (1 << 64) - 1
                yield np.unique(words), mix(np.array([whole], np.uint64))
            else:
                yield words, words

    for t in texts:
        held.append((t or "").encode("utf-8", "surrogatepass").lower())
        size += len(held[-1])
        if size > CHUNK:
            yield from done()
            held, size = [], 0
    if held:
        yield from done()


def word_fingerprint(words: np.ndarray) -> int:
    """SimHash of a text's distinct words, given as hashes; zero for none."""
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(words), 1 << 15):
        ones += _bits(words[lo : lo + (1 << 15)]).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(words), bitorder="little").view(np.uint64)[0])


#: Minima of a band, and how likely a pair of the least similarity may share none of the bands.
BAND_ROWS, MISSED = 5, 1e-5


def band_count(least: float) -> int:
    """How many bands leave a pair of similarity `least` unmet with probability MISSED at most, whatever kind of edit parts it."""
    return 1 if least >= 1 else math.ceil(math.log(MISSED) / math.log1p(-(least**BAND_ROWS)))


def minhash_bands(hashes: np.ndarray, bands: int) -> np.ndarray:
    """A key for each band: the least of the hashes under BAND_ROWS permutations of 32 bits, mixed with the band's number."""
    rng = np.random.default_rng(42)
    turn, odd = rng.integers(0, 1 << 32, (2, bands * BAND_ROWS, 1), dtype=np.uint32)
    h, low = (hashes >> np.uint64(32)).astype(np.uint32), np.full(len(odd), (1 << 32) - 1, np.uint32)
    for lo in range(0, len(h), 1024):
        low = np.minimum(low, ((h[lo : lo + 1024] ^ turn) * (odd | np.uint32(1))).min(axis=1))
    key = np.arange(bands, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for row in low.reshape(bands, BAND_ROWS).T:
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + row)
    return key


def _signatures(docs: DataFrame, shingle: int, bands: int) -> DataFrame:
    """doc_id, th, fp (over distinct words), bands: those of the text's shingles, none for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, keys = [], []
            for words, shingles in hashed_sets((t.as_py() for t in batch.column(2)), shingle):
                fp.append(word_fingerprint(words))
                keys.append(minhash_bands(shingles, bands).view(np.int64) if len(shingles) else [])
            fps = pa.array(np.array(fp, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "fp", "bands"])

    return _hashed(docs).mapInArrow(run, "doc_id long, th long, fp long, bands array<long>")


def _band_links(texts: DataFrame) -> DataFrame:
    """Links a, b that join the fingerprints of texts (fp, bands) with a band in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, fp = (np.concatenate([x[-1:], np.asarray(batch.column(i))]) for i, x in enumerate((key, fp)))  # the last key may go on
            same = (key[1:] == key[:-1]) & (fp[1:] != fp[:-1])
            if same.any():
                a, b = forest(fp[1:][same], fp[:-1][same])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = texts.select(F.explode("bands").alias("key"), "fp")
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, LINKS)


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def _compare(th: np.ndarray, fp: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, distance: int, least: float) -> list[tuple[int, int]]:
    """A forest over the texts of a cell that joins what its pairs of similar texts join. Pairs already joined are not compared; a text may stand on both sides.

    A text is compared with all its candidates at once: its shingles are marked, and the marks under each candidate's shingles are counted.
    """
    root = np.unique(th, return_inverse=True)[1]
    size = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(size)
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark, out = np.zeros(len(known), bool), []
    for u in rows.tolist():
        near = columns[root[columns] != root[u]]
        near = near[(np.bitwise_count(fp[near] ^ fp[u]) <= distance) | (bands[near] == bands[u]).any(axis=1)]
        if not len(near):
            continue
        mine = flat[ends[u] - size[u] : ends[u]]
        mark[mine] = True
        if len(near) < 16:
            both = np.array([np.count_nonzero(mark[flat[ends[v] - size[v] : ends[v]]]) for v in near.tolist()])
        else:
            sums = np.concatenate([[0], np.cumsum(mark[flat])])
            both = sums[ends[near]] - sums[ends[near] - size[near]]
        mark[mine] = False
        alike = near[both >= least * (size[u] + size[near] - both)]
        if len(alike):
            joined, first = np.unique(root[alike], return_index=True)
            out += [(u, int(v)) for v in alike[first]]
            root[np.isin(root, joined)] = root[u]
    return out


#: Texts of a large group that all others are compared with first.
LEADERS = 3
CELLS = ("group", "a", "b")


def _cells(rows: DataFrame, distance: int, least: float) -> DataFrame:
    """Links a, b of similar texts that share a signature and meet in a cell (group, a, b): those with side 0 or 2 against those with side 1 or 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                side, th, fp, bands, data = zip(*held)
                side, th, fp = np.array(side), np.array(th, np.int64), np.array(fp, np.int64).view(np.uint64)
                bands = np.frombuffer(b"".join(bands), np.uint32).reshape(len(held), -1)
                links = _compare(th, fp, bands, [np.frombuffer(x, np.uint64) for x in data], np.flatnonzero(side != 1), np.flatnonzero(side != 0), distance, least)
                if links:
                    a, b = np.array(links).T
                    yield pa.RecordBatch.from_arrays([pa.array(th[a]), pa.array(th[b])], names=["a", "b"])

        for batch in batches:
            for g, a, b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, a, b) != now:
                    yield from out()
                    now, held = (g, a, b), []
                held.append(row)
        yield from out()

    return rows.select(*CELLS, "side", "th", "fp", "bands", "shingles").repartition(*CELLS).sortWithinPartitions(*CELLS).mapInArrow(run, LINKS)


def _led(rows: DataFrame, least: float) -> DataFrame:
    """group, th, lead for each text of rows (group, th, shingles, parts): a leader of its group that it is joined with, null if there is none.

    The leaders of a group, LEADERS texts with the least hashes, go to each of the group's parts; of those that join each other the first stands for all.
    """
    nth = F.row_number().over(Window.partitionBy("group").orderBy(F.xxhash64("th"), "th"))
    first = rows.select("group", "th").withColumn("nth", nth).where(F.col("nth") <= LEADERS)
    lead = rows.join(first.select("th", "nth"), "th")
    lead = lead.select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "nth", "th", "shingles")
    members = rows.select("group", F.pmod(F.xxhash64("th", F.lit(1)), "parts").cast("int").alias("part"), F.lit(LEADERS + 1).alias("nth"), "th", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads = None, []
        for batch in batches:
            out = []
            for g, part, nth, th, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, part) != now:
                    now, heads = (g, part), []
                own = np.frombuffer(data, np.uint64)
                if nth <= LEADERS:
                    heads.append((own, next((x for s, x in heads if _alike(own, s, least)), th)))
                else:
                    out.append((g, th, next((x for s, x in heads if _alike(own, s, least)), None)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["group", "th", "lead"])

    keys = ("group", "part")
    return lead.unionByName(members).repartition(*keys).sortWithinPartitions(*keys, "nth").mapInArrow(run, "group long, th long, lead long")


def _similar(sets: DataFrame, distance: int, least: float, work: Workspace) -> DataFrame:
    """Links a, b of texts (group, th, fp, bands, shingles, n) of one group that are within the distance or share a band, and are similar.

    A group of few shingles and texts is one cell. Of a large one each text is first compared with the group's leaders, which joins most copies of one text at once; the texts that
    joined the largest part of the group need no comparison with each other, and only the rest meet all others, in a grid of cells.
    """
    sides = F.greatest(F.ceil(F.sum("n") / CELL), F.ceil(F.count("*") / TEXTS)).cast("int")
    sizes = sets.groupBy("group").agg(sides.alias("parts"), F.count("*").alias("k")).where("parts > 1")
    large = work.keep(sizes, "large")
    few = sets.join(large, "group", "left_anti").withColumns({"a": F.lit(0), "b": F.lit(0), "side": F.lit(2)})
    links = _cells(few, distance, least)
    if not large.limit(1).collect():
        return links
    total = sets.count()
    rows = work.keep(join_counted(sets, large, "group", total, "k"), "large_rows")
    found = work.keep(_led(rows, least), "led")
    joined = found.where("lead is not null").groupBy("group", "lead").agg(F.count("*").alias("c"))
    main = joined.groupBy("group").agg(F.max(F.struct("c", "lead")).alias("m")).select("group", F.col("m.lead").alias("main"))
    named = work.keep(large.join(main, "group"), "main")  # each leader joins itself
    rest = work.keep(join_counted(found, named, "group", total, "k").where("lead is null or lead <> main").select("th"), "rest")
    others = rows.join(rest, "th", "left_semi")
    open_ = work.keep(others.groupBy("group").agg(sides.alias("rest_parts")).join(large, "group").select("group", "rest_parts", "k"), "open")
    part = lambda seed, n: F.pmod(F.xxhash64("th", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    grid = join_counted(rows, open_, "group", total, "k")
    left = grid.join(rest, "th", "left_semi").withColumns({"a": part(2, "rest_parts"), "b": every("parts"), "side": F.lit(0)})
    right = grid.withColumns({"b": part(3, "parts"), "a": every("rest_parts"), "side": F.lit(1)})
    led = found.where("lead <> th").select(F.col("th").alias("a"), F.col("lead").alias("b"))
    return links.union(led).union(_cells(left.unionByName(right), distance, least))


def similar_documents(docs: DataFrame, least: float = 0.8, shingle: int = 5, distance: int = 3) -> DataFrame:
    """doc_id, th (hash of the text), label, component_id for each row of docs (doc_id, text): documents joined by Jaccard similarity of `least` or more of their distinct
    word shingles (A-Z in lower case). The label is the least text hash of a component, and names those without any doc_id too.

    Candidates are groups joined by either of two signatures: SimHash over distinct single words, at `distance` bits or fewer, and bands of the least hashes of the shingles, which
    a pair of the similarity shares however its edits lie (all but MISSED of the pairs at `least` itself, fewer above). In a group pairs that share a signature are compared
    exactly, unless other pairs join them already. The README has the recall for each kind of edit.
    Texts without words are similar to each other. Nulls, repeated rows and other columns are as in near_duplicates().
    """
    work = Workspace(docs.sparkSession, "similar")
    bands = band_count(least)
    marked = work.keep(_signatures(docs, shingle, bands), "fingerprints")
    texts = work.keep(marked.groupBy("th", "fp").agg(F.min("doc_id").alias("root"), F.first("bands").alias("bands"), F.count("*").alias("n")), "texts")
    fps = work.keep(texts.groupBy("fp").agg(F.count("*").alias("n")), "fps")
    groups = work.keep(connected_components(near_links(fps.select("fp"), distance).union(_band_links(texts)), contracted=True), "groups")
    grouped = work.keep(fps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("label", "fp").alias("group")), "grouped")
    many = work.keep(grouped.groupBy("group").agg(F.sum("n").alias("texts"), F.count("*").alias("k")).where("texts > 1").select("group", "k"), "many")
    named = work.keep(join_counted(grouped, many, "group", grouped.count(), "k"), "named")
    picked = work.keep(join_counted(texts.select("th", "fp", "root"), named, "fp", texts.count()), "candidates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                sets = [x for _, x in hashed_sets((t.as_py() for t in part.column(3)), shingle)]
                # A band is cut to 32 bits: a chance match costs a comparison.
                keys = [(minhash_bands(x, bands) if len(x) else np.zeros(bands, np.uint64)).astype(np.uint32).tobytes() for x in sets]
                data = [pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) + 1 for x in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *data], names=["group", "th", "fp", "bands", "shingles", "n"])

    # One row for each text that has a candidate, the one with the least doc_id: its copies aren't looked up, so no key is large.
    wanted = picked.select("th", "root").hint("shuffle_hash").alias("p")
    one = _hashed(docs).alias("d").join(wanted, (F.col("d.th") == F.col("p.th")) & F.col("d.doc_id").eqNullSafe(F.col("p.root")), "left_semi").groupBy("th").agg(F.first("text").alias("text"))
    sets = one.join(picked, "th").select("group", "th", "fp", "text").mapInArrow(run, "group long, th long, fp long, bands binary, shingles binary, n long")
    labels = work.keep(connected_components(_similar(work.keep(sets, "sets"), distance, least, work), contracted=True), "labels")
    work.drop("fps", "groups", "grouped", "many", "named", "candidates", "sets")
    named = _named(texts.select("th", "root", "n"), labels, "th", work)
    return join_counted(marked.select("doc_id", "th"), named, "th", marked.count()).select("doc_id", "th", "label", "component_id")
