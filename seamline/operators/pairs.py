"""Similarities of pairs in long form: i, j, v with i < j."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from seamline.workspace import Workspace


def members(df: DataFrame, group: Column, node: Column) -> DataFrame:
    """The nodes of each group, repeats and all: g, n."""
    return df.select(group.alias("g"), node.alias("n")).where("g is not null and n is not null")


def items(df: DataFrame, group: Column, node: Column) -> DataFrame:
    """The set of nodes of each group: g, n."""
    return members(df, group, node).distinct()


#: Members of a group that meet each other in one piece.
BLOCK = 1024


def _meet(rows: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """l, r: structs (n, x) of each two rows (key, n, x) of a group, the smaller n first; n stands once in a group. rows are read several times, so they should be a table.

    A group of more than `block` members is cut into blocks, and each two blocks meet in a cell of their own: the triangle of cells is dealt out, and none makes more pairs than two blocks do.
    A member goes to as many cells as the group has blocks.
    """
    large = rows.groupBy(key).agg(F.count("*").alias("_m")).where(F.col("_m") > block).select(key, F.ceil(F.col("_m") / (block / 2)).cast("int").alias("_blocks"))
    r = rows.join(large, key, "left").select(key, F.struct("n", "x").alias("row"), F.coalesce("_blocks", F.lit(1)).alias("_blocks"))
    r = r.withColumn("_own", F.pmod(F.xxhash64("row.n"), "_blocks").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cell = [key, "_a", "_b"]
    r = r.select(key, "row", "_own", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"))
    left, right = r.where("_own = _a").select(*cell, F.col("row").alias("p")), r.where("_own = _b").select(*cell, F.col("row").alias("q"))
    met = left.join(right, cell).where((F.col("_a") < F.col("_b")) | (F.col("p.n") < F.col("q.n")))
    return met.select(F.least("p", "q").alias("l"), F.greatest("p", "q").alias("r"))


def _together(rows: DataFrame, block: int) -> DataFrame:
    """i, j, co with i <= j: groups (g, n: a node may stand several times) that have both nodes; of a node with itself, all its groups.

    A group of at most `block` rows becomes one list, put together where its rows lie first, and makes its pairs itself; a larger one meets in cells. Counts are summed up before they are dealt out, so a busy pair is one row a task.
    """
    work = Workspace(rows.sparkSession, "pairs")
    rows = work.keep(rows.select("g", "n"), "rows")
    large = work.keep(rows.groupBy("g").agg(F.count("*").alias("_m")).where(F.col("_m") > block).select("g"), "large")
    any_large = bool(large.limit(1).collect())
    lists = (rows.join(large, "g", "left_anti") if any_large else rows).groupBy("g").agg(F.array_sort(F.collect_set("n")).alias("ns"))
    left = lists.select("ns", F.posexplode("ns").alias("k", "i"))
    out = left.select("i", F.explode(F.slice("ns", F.col("k") + 1, F.size("ns"))).alias("j"))
    if any_large:
        sets = work.keep(rows.join(large, "g", "left_semi").distinct(), "sets")
        met = _meet(sets.withColumn("x", F.lit(1)), "g", block).select(F.col("l.n").alias("i"), F.col("r.n").alias("j"))
        out = out.union(met).union(sets.select(F.col("n").alias("i"), F.col("n").alias("j")))
    return out.groupBy("i", "j").agg(F.count("*").alias("co"))


def cooccurrence(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """i, j, co: groups (g, n) that have both nodes; a group with many nodes is many tasks."""
    return _together(rows, block).where("i < j")


def jaccard(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Shared groups over all groups (g, n) of either node; pairs without a shared group are absent. The counts are a table, so whoever reads the result several times joins no group again."""
    co = Workspace(rows.sparkSession, "pairs").keep(_together(rows, block), "co")
    own = lambda n, c: co.where("i = j").select(F.col("i").alias(n), F.col("co").alias(c))
    return co.where("i < j").join(own("i", "ci"), "i").join(own("j", "cj"), "j").select("i", "j", (F.col("co") / (F.col("ci") + F.col("cj") - F.col("co"))).alias("v"))


def count_cosine(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Cosine of sparse rows given as n, k, c (node, coordinate, count; each coordinate of a node once); pairs without a shared coordinate are absent."""
    counts = Workspace(counts.sparkSession, "pairs").keep(counts.select("n", "k", "c"), "counts")
    norm = counts.groupBy("n").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("z"))
    dot = _meet(counts.withColumnRenamed("c", "x"), "k", block).groupBy(F.col("l.n").alias("i"), F.col("r.n").alias("j")).agg(F.sum(F.col("l.x") * F.col("r.x")).alias("d"))
    return (
        dot.join(norm.select(F.col("n").alias("i"), F.col("z").alias("zi")), "i").join(norm.select(F.col("n").alias("j"), F.col("z").alias("zj")), "j")
        .select("i", "j", (F.col("d") / (F.col("zi") * F.col("zj"))).alias("v"))
    )


#: Blocks that vectors are cut into at most while a block's vectors take no more than SIDE bytes as doubles, and rows of a block that meet at once.
SIDES, SIDE, TILE = 12, 32 << 20, 512
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def _cells(vectors: DataFrame, block: int) -> DataFrame:
    """vectors (n, e, label) with the cells a, b they go to: one for each block of the others, on or above the diagonal.

    Blocks of `block` vectors grow with the input once there are SIDES of them, so a vector is dealt out SIDES times, however many there are; more often only where a block would exceed SIDE bytes.
    """
    most = vectors.agg(F.count("*").alias("n"), F.max(F.size("e")).alias("dim")).first()
    rows = max(1, SIDE // (8 * max(1, most["dim"] or 1)))
    blocks = max(1, min(-(-most["n"] // block), max(SIDES, -(-most["n"] // rows))))
    v = vectors.select("n", "e", "label", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int").alias("own"))
    cells = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = cells.select("n", "e", "label", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    return cells.repartition(4 * min(blocks * (blocks + 1) // 2, SIDES * (SIDES + 1) // 2), "a", "b")  # so that hashes seldom put two cells in one task


def _cosine_cells(vectors: DataFrame, found: Callable, schema: str, block: int) -> DataFrame:
    """Rows that `found` makes of the tiles of each cell of all pairs of vectors (n: long, e: array of numbers, label).

    found goes through tiles (ids of the left and of the right rows, their labels, the matrix of their cosines, and which of its entries are pairs, or None for all) and yields columns of rows. A zero vector has cosine 0 with all.
    """
    types = [ARROW[x.split()[1]] for x in schema.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]

    def side(t: pa.Table):
        e = t["e"].combine_chunks()
        m = np.asarray(e.flatten()).astype(float).reshape(len(t), -1)
        if e.null_count or (np.asarray(pc.list_value_length(e)) != m.shape[1]).any():
            raise ValueError("vectors must have one length")
        return np.asarray(t["n"]), np.asarray(t["label"]), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def tiles(left, right, same: bool):
        for x in range(0, len(left[0]), TILE):
            i, li, m = (c[x : x + TILE] for c in left)
            for y in range(x if same else 0, len(right[0]), TILE):  # rows of one block stand in order, so pairs lie above the diagonal
                j, lj, w = (c[y : y + TILE] for c in right)
                yield i, j, li, lj, m @ w.T, i[:, None] < j[None, :] if same and i[-1] >= j[0] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("n")
        a, b = t["a"][0], t["b"][0]
        left = side(t.filter(pc.equal(t["own"], a))) if pc.any(pc.equal(t["own"], a)).as_py() else None
        right = left if a == b else side(t.filter(pc.equal(t["own"], b))) if pc.any(pc.equal(t["own"], b)).as_py() else None
        del t
        for columns in found(tiles(left, right, a == b)) if left and right else ():
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, types)], names=names)

    return _cells(vectors, block).groupBy("a", "b").applyInArrow(run, schema)


def _listed(i, j, v, pick):
    """A tile's pairs, each with the smaller id first, and their values."""
    columns = np.minimum(i[:, None], j[None, :]), np.maximum(i[:, None], j[None, :]), v
    return [c.ravel() if pick is None else c[pick] for c in columns]


#: Tiles of a cell whose pairs are put in order together, 128 MB as keys, and pairs that go out at once.
PIECE, OUT = 64, 1 << 18


def _rounded_tiles(tiles: Iterator[tuple], digits: int) -> Iterator[list[np.ndarray]]:
    """i, j, v of the pairs of tiles, v rounded with halves away from zero, PIECE tiles at a time in the order of v: equal values that follow each other take little room in a file.

    A key is the rounded value, then the pair's tile and its place there. Pairs without a finite value go out as they are.
    """
    scale, bits = 10.0**digits, (TILE * TILE - 1).bit_length()
    low = bits + (PIECE - 1).bit_length()
    keys, sides, n = np.empty(PIECE * TILE * TILE, np.int64), [], 0

    def together():
        keys[:n].sort()
        i, j = (np.zeros((len(sides), TILE), np.int64) for _ in range(2))
        for k, (p, q) in enumerate(sides):
            i[k, : len(p)], j[k, : len(q)] = p, q
        for at in range(0, n, OUT):
            key = keys[at : min(at + OUT, n)]
            k, place = (key & (1 << low) - 1) >> bits, key & (1 << bits) - 1
            p, q = i[k, place // TILE], j[k, place % TILE]
            yield [np.minimum(p, q), np.maximum(p, q), (key >> low) / scale]

    place = np.arange(TILE * TILE).reshape(TILE, TILE)
    for i, j, _, _, s, pick in tiles:
        odd = ~np.isfinite(s)
        if odd.any():
            yield _listed(i, j, s, odd if pick is None else odd & pick)
            pick = ~odd if pick is None else pick & ~odd
            s[odd] = 0
        s *= scale
        s += np.copysign(0.5, s)
        key = (s.astype(np.int64) << low) + (len(sides) << bits) + place[: len(i), : len(j)]
        key = key.ravel() if pick is None else key[pick]
        keys[n : n + len(key)] = key
        n += len(key)
        sides.append((i, j))
        if len(sides) == PIECE:
            yield from together()
            sides, n = [], 0
    yield from together()


def dense_cosine(vectors: DataFrame, block: int = 1024, digits: int | None = None) -> DataFrame:
    """i, j, v: the cosine of all pairs of dense vectors (n: long, e: array of numbers), block against block; a zero vector has cosine 0 with all.

    digits: at most 9, v is rounded where the pairs are made, and they come in the order of v within pieces.
    """

    def found(tiles):
        if digits is not None:
            yield from _rounded_tiles(tiles, digits)
            return
        for i, j, _, _, s, pick in tiles:
            yield _listed(i, j, s, pick)

    return _cosine_cells(vectors.withColumn("label", F.lit(0)), found, "i long, j long, v double", block)


def cosine_deemphasised(vectors: DataFrame, both: float = 0.6, one: float = 0.8, block: int = 1024, digits: int | None = None) -> DataFrame:
    """i, j, v: (cosine + 1) / 2 of all pairs of vectors (n, e, entity: boolean), as fusion.deemphasised weakens it, clipped; the factors are taken where the pairs are made, so no pair is dealt out again. digits: as in dense_cosine."""
    factors = np.array([1.0, one, both])

    def weak(tiles):
        for i, j, li, lj, s, pick in tiles:
            yield i, j, li, lj, np.clip((s + 1) / 2 * factors[li[:, None] + lj[None, :]], 0, 1), pick

    def found(tiles):
        if digits is not None:
            yield from _rounded_tiles(weak(tiles), digits)
            return
        for i, j, _, _, s, pick in weak(tiles):
            yield _listed(i, j, s, pick)

    return _cosine_cells(vectors.select("n", "e", F.coalesce(F.col("entity").cast("int"), F.lit(0)).alias("label")), found, "i long, j long, v double", block)


def cosine_histogram(vectors: DataFrame, bins: int = 60, block: int = 1024) -> DataFrame:
    """same, bin, n: pairs of vectors (n, e, label: long) by whether they share a label and by the bin of (cosine + 1) / 2, counted where they are made."""

    def found(tiles):
        every, within = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
        for _, _, li, lj, s, pick in tiles:
            s += 1
            s /= 2
            v, same = np.round(s, 9, out=s), li[:, None] == lj[None, :]
            if pick is not None or not (v.min() >= 0 and v.max() <= 1):
                inside = (v >= 0) & (v <= 1) if pick is None else (v >= 0) & (v <= 1) & pick
                v, same = v[inside], same[inside]
            v *= bins
            cell = v.astype(np.int64)  # v is not negative
            np.minimum(cell, bins - 1, out=cell)
            every += np.bincount(cell.ravel(), minlength=bins)
            within += np.bincount(cell[same], minlength=bins)
        for same, counts in ((True, within), (False, every - within)):
            at = np.flatnonzero(counts)
            yield np.full(len(at), same), at.astype(np.int32), counts[at]

    return _cosine_cells(vectors, found, "same boolean, bin int, n long", block).groupBy("same", "bin").agg(F.sum("n").alias("n"))


def cosine_above(vectors: DataFrame, least: float, block: int = 1024) -> DataFrame:
    """same, n, total: how many pairs of vectors (n, e, label: long) have (cosine + 1) / 2 above `least`, and their sum, by whether they share a label. Negative labels are left out."""

    def found(tiles):
        n, total = [0, 0], [0.0, 0.0]
        for _, _, li, lj, s, pick in tiles:
            s += 1
            s /= 2
            keep = s > least if pick is None else (s > least) & pick
            same, v = (li[:, None] == lj[None, :])[keep], s[keep]
            inside = v[same]
            n[1] += len(inside)
            n[0] += len(v) - len(inside)
            total[1] += float(inside.sum())
            total[0] += float(v[~same].sum())
        yield [False, True], n, total

    return _cosine_cells(vectors.where("label >= 0"), found, "same boolean, n long, total double", block).groupBy("same").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def cosine_top(vectors: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """i, j, v, same: the k pairs of vectors (n, e, label: long) with the largest (cosine + 1) / 2 (to nine digits), then by i, j. A cell sends its k best.

    Once a cell has k pairs, only those that reach the kth are looked at: of all others no more than the cosine is taken.
    """

    def found(tiles):
        best, floor = None, -np.inf
        for i, j, li, lj, s, pick in tiles:
            if pick is not None:
                s[~pick] = -np.inf
            least = floor
            if s.size > k and best is None:
                least = np.partition(s, s.size - k, axis=None)[s.size - k] - 4e-9
            at = np.flatnonzero((s >= least) & (s > -np.inf))
            if not len(at):
                continue
            x, y = np.divmod(at, s.shape[1])
            new = [np.minimum(i[x], j[y]), np.maximum(i[x], j[y]), np.round((s[x, y] + 1) / 2, 9), li[x] == lj[y]]
            best = new if best is None else [np.concatenate(c) for c in zip(best, new)]
            order = np.lexsort((best[1], best[0], -best[2]))[:k]
            best = [c[order] for c in best]
            if len(order) == k and k:
                floor = 2 * best[2][-1] - 1 - 4e-9  # more than rounding moves a cosine
        if best is not None:
            yield best

    return _cosine_cells(vectors, found, "i long, j long, v double, same boolean", block).orderBy(F.desc("v"), "i", "j").limit(k)


def cosine_intra_inter(vectors: DataFrame) -> DataFrame:
    """One row: intra, inter, n_intra, n_inter, ratio of (cosine + 1) / 2 within and between labels of vectors (n, e, label; negative labels are out), without any pair.

    The cosines of a set add up to the square of the sum of its unit vectors, less what each has with itself, by two.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, label = np.asarray(pc.list_value_length(batch.column(1)).fill_null(0)), np.asarray(batch.column(0))
            out = []
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                e = np.asarray(batch.column(1).take(pa.array(at)).flatten()).astype(float).reshape(len(at), dim)
                z = np.linalg.norm(e, axis=1)
                names, of = np.unique(label[at], return_inverse=True)
                s = np.zeros((len(names), dim))
                np.add.at(s, of, e / np.where(z > 0, z, 1.0)[:, None])
                out += list(zip(names.tolist(), np.bincount(of).tolist(), np.bincount(of, z > 0).astype(np.int64).tolist(), s.tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())))], names=["label", "c", "own", "s"])

    # A batch leaves one row for each label and length of vector.
    part = vectors.where("label >= 0").select(F.col("label").cast("long").alias("label"), F.col("e").cast("array<double>").alias("e")).mapInArrow(added, "label long, c long, own long, s array<double>")
    part = Workspace(vectors.sparkSession, "intra").keep(part, "sums")
    sums = part.select("label", F.posexplode("s").alias("k", "x")).groupBy("label", "k").agg(F.sum("x").alias("s"))
    squares = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    counts = part.groupBy("label").agg(F.sum("c").alias("c"), F.sum("own").alias("own"))
    labels = counts.join(squares, "label", "left").fillna(0.0, ["q"])
    inside = labels.agg(F.sum((F.col("q") - F.col("own")) / 2).alias("cos_in"), F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("n_intra"), F.sum("c").alias("c"), F.sum("own").alias("own"))
    whole = sums.groupBy("k").agg(F.sum("s").alias("s")).agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("q"))
    row = inside.join(F.broadcast(whole))  # one row each
    row = row.select("cos_in", "n_intra", ((F.col("q") - F.col("own")) / 2 - F.col("cos_in")).alias("cos_out"), ((F.col("c") * (F.col("c") - 1) / 2).cast("long") - F.col("n_intra")).alias("n_inter"))
    mean = lambda c, n: F.when(F.col(n) > 0, (F.col(c) / F.col(n) + 1) / 2)
    out = row.select(mean("cos_in", "n_intra").alias("intra"), mean("cos_out", "n_inter").alias("inter"), "n_intra", "n_inter")
    return out.withColumn("ratio", F.when(F.col("inter") != 0, F.col("intra") / F.col("inter")))


def mirrored(sim: DataFrame) -> DataFrame:
    """Both directions of each pair."""
    return sim.select("i", "j", "v").union(sim.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def interval_join(spans: DataFrame, windows: DataFrame, key: list[str], slack: int = 0, contained: bool = True, width: int = 3_600_000) -> DataFrame:
    """Spans (key, s, t) inside windows (key, ws, wt), or overlapping them, with slack at both ends.

    Time is cut into buckets of `width`. A window is put into each bucket it reaches; a span meets it in the bucket of its own start, or of the window's where that is later, so no pair is met twice.
    """
    lo, hi = F.col("ws") - slack, F.col("wt") + slack
    w = windows.withColumn("_b", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("s") if contained else F.col("t")) / width))))
    fits = (F.col("s") >= lo) & (F.col("t") <= hi) if contained else (F.col("s") <= hi) & (F.col("t") >= lo)
    return s.join(w, [*key, "_b"]).where(fits & (F.col("_b") == F.floor(F.greatest(F.col("s"), lo) / width))).drop("_b")


def ordinal_join(left: DataFrame, right: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The kth row of a key on the left with the kth on the right, by order; columns of the right but the key get the prefix r_."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias("k")
    a = left.select("*", nth)
    b = right.select(*key, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in key), nth)
    return a.join(b, [*key, "k"])
