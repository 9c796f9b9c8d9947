"""Exact top-k inner products by vector-approximation files.

Each vector has an approximation: the cell of each component among a few intervals of its dimension. Queries meet vectors in blocks. A scan of the cells
bounds every inner product from both sides; only vectors whose upper bound reaches the kth best lower bound can matter, and their exact components
are read in order of the bound until the kth result is certain. The best of each block are then merged. A bounded sample gives every query a score that its
kth best is sure to reach, so most blocks read and send only what can matter in the whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from seamline.workspace import Workspace

SCALE = 64
#: The largest long.
LAST = (1 << 63) - 1
PREPARED = "vec_id long, dim int, data binary"
FOUND = "query_id long, vec_id long, score long"


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, data (the components as doubles, little-endian) for vectors of finite components. Null ids and vectors take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            flat = np.asarray(values.flatten().fill_null(np.nan)).astype("<f8")
            size = np.diff(np.asarray(values.offsets))
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            fit = np.flatnonzero(bad[ends] == bad[ends - size])
            data = [flat[ends[i] - size[i] : ends[i]].tobytes() for i in fit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fit)), pa.array(size[fit].astype(np.int32)), pa.array(data, pa.binary())], names=["vec_id", "dim", "data"])

    flat = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return flat.mapInArrow(run, PREPARED)


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: the product only moves the exponent. Beyond the range of doubles it is infinite."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x)


def _whole(x: float) -> int:
    return math.floor(SCALE * x) if math.isfinite(SCALE * x) else SCALE * int(x)


class Approximations:
    """Cells of a block of vectors: each dimension cut into intervals of about equal numbers, and the interval each component lies in."""

    def __init__(self, exact: np.ndarray, bits: int):
        n, dim = exact.shape
        self.cells = np.zeros((n, dim), np.uint8)
        self.middle, self.half = np.zeros((dim, 1 << bits)), np.zeros((dim, 1 << bits))
        for d in range(dim):
            column = exact[:, d]
            edges = np.unique(np.quantile(column, np.linspace(0, 1, (1 << bits) + 1)[1:-1], method="lower"))
            self.cells[:, d] = cell = np.searchsorted(edges, column, "left")
            low, high = np.full(1 << bits, np.inf), np.full(1 << bits, -np.inf)
            np.minimum.at(low, cell, column)
            np.maximum.at(high, cell, column)
            used = low <= high
            with np.errstate(over="ignore", invalid="ignore"):
                self.middle[d, used], self.half[d, used] = (low[used] + high[used]) / 2, (high[used] - low[used]) / 2

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all inner products, from the cells alone."""
        each = np.arange(self.cells.shape[1])
        middle, half = self.middle[each, self.cells], self.half[each, self.cells]
        with np.errstate(over="ignore", invalid="ignore"):
            center, spread = queries @ middle.T, np.abs(queries) @ half.T
            slack = 1e-9 * (np.abs(queries) @ (np.abs(middle) + half).T) + 1e-6  # rounding of large numbers
            low, high = center - spread - slack, center + spread + slack
        # What overflows bounds nothing but that scores are longs.
        sound = np.isfinite(low) & np.isfinite(high)
        return np.clip(np.where(sound, low, -np.inf), -(2.0**63), 2.0**63), np.clip(np.where(sound, high, np.inf), -(2.0**63), 2.0**63)


def _exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of floor(SCALE * x) as longs: by doubles where those are exact and else by whole numbers of any size, cut to a long."""
    q, v = scaled(query), scaled(vectors)
    with np.errstate(over="ignore", invalid="ignore"):
        if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * len(q) < 2.0**53:
            return (v @ q).astype(np.int64)
    a = [_whole(x) for x in query.tolist()]
    return np.array([max(-LAST - 1, min(LAST, sum(x * _whole(y) for x, y in zip(a, row) if x))) for row in vectors.tolist()], np.int64)


def search_block(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, bits: int, step: int = 64) -> list[tuple[int, int, int]]:
    """The k best of a block for each query, but itself: rows of FOUND. Ties go to the smaller id. What is surely below the query's floor needn't come."""
    out = []
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    va = Approximations(scaled(vectors), bits)
    rows = max(1, (1 << 21) // len(ids))
    for lo in range(0, len(queries), rows):
        low, high = va.bounds(scaled(queries[lo : lo + rows]))
        own = query_ids[lo : lo + rows, None] == ids[None, :]
        low[own], high[own] = -np.inf, -np.inf
        kth = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(low), -np.inf)
        kth = np.maximum(kth, floors[lo : lo + rows])
        for q in range(len(low)):
            near = np.flatnonzero((high[q] >= kth[q]) & ~own[q])
            near = near[np.argsort(-high[q][near], kind="stable")]
            best_score, best_at = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for at in range(0, len(near), step):
                if len(best_score) == k and best_score[-1] > high[q][near[at]]:
                    break  # nothing that follows can reach the kth
                part = near[at : at + step]
                score = np.concatenate([best_score, _exact(queries[lo + q], vectors[part])])
                where = np.concatenate([best_at, part])
                top = np.lexsort((where, ~score))[:k]  # ~ turns the order of all longs round
                best_score, best_at = score[top], where[top]
            out += [(int(query_ids[lo + q]), int(ids[i]), int(s)) for s, i in zip(best_score, best_at) if s >= floors[lo + q]]
    return out


def _matrix(data, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<f8").reshape(-1, dim) if dim else np.zeros((len(data), 0))


def with_floors(queries: DataFrame, vectors: DataFrame, k: int, sample_bytes: int) -> DataFrame:
    """queries with `floor`: a score that each query's kth best is sure to reach, from the vectors of a sample of about sample_bytes. It only saves work in every block."""
    longest = vectors.agg(F.max("dim")).first()[0] or 0
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "data").limit(max(1, sample_bytes // (8 * longest + 8))).collect()
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in picked}:
        rows = [r for r in picked if r["dim"] == dim]
        known[dim] = np.array([r["vec_id"] for r in rows]), scaled(_matrix([r["data"] for r in rows], dim))
    held = vectors.sparkSession.sparkContext.broadcast(known)  # sample_bytes, and one vector at least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, floors = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.full(len(batch), -np.inf)
            for dim, (others, x) in held.value.items():
                of = np.flatnonzero(dims == dim)
                for lo in range(0, len(of), 256):
                    at = of[lo : lo + 256]
                    q = scaled(_matrix([batch.column(2)[i].as_py() for i in at.tolist()], dim))
                    with np.errstate(over="ignore", invalid="ignore"):
                        score, size = q @ x.T, np.abs(q) @ np.abs(x).T
                    # What may be off by rounding or overflow proves nothing; a score beyond a long counts as a long.
                    low = np.where(np.isfinite(size), np.minimum(score - size * 1e-9 - 1, 2.0**63), -np.inf)
                    low[ids[at][:, None] == others[None, :]] = -np.inf
                    if len(others) >= k:
                        floors[at] = np.partition(low, len(others) - k, axis=1)[:, len(others) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors)], names=["vec_id", "dim", "data", "floor"])

    return queries.mapInArrow(run, f"{PREPARED}, floor double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, bits: int = 5, block: int = 8192, cells: int = 16, sample_bytes: int = 1 << 22) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of vectors with the highest inner product of floor(SCALE * x) for each row of queries (both vec_id, embedding).

    Rows with the query's own id don't count; equal scores go to the smaller vec_id, and fewer than k rows are all returned. Only vectors of one length compare. Equal rows are candidates each; a
    query that stands several times is answered once, by its shortest vector and of those the first by content. Vectors that are null, or hold null or non-finite components, take no part, nor do null ids; finite ones of any
    size do. A score beyond a long is the long next to it. Empty tables: no rows. Other columns are ignored.

    `block`: queries and vectors of a cell of the grid. Of few rows the blocks are smaller, so that there are `cells` cells for the tasks.
    """
    work = Workspace(vectors.sparkSession, "topk")
    # Of equal rows k can be among the k best of a query. Of equal vectors 2k can, by the least ids: at most k rows have the query's own id, and k are left.
    own = F.row_number().over(Window.partitionBy("dim", "data", "vec_id").orderBy(F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("dim", "data").orderBy("vec_id"))
    v = work.keep(prepared(vectors).withColumn("own", own).where(F.col("own") <= k).withColumn("nth", nth).where(F.col("nth") <= 2 * k).select("vec_id", "dim", "data"), "vectors")
    first = F.min(F.struct("dim", "data")).alias("first")
    asked = prepared(queries).groupBy("vec_id").agg(first).select("vec_id", "first.dim", "first.data")
    q = work.keep(with_floors(asked, v, k, sample_bytes), "queries")
    n, m = v.count(), q.count()
    rows = max(1, -(-m // block))
    columns = max(1, -(-n // block), min(-(-n // 512), cells // rows))
    # Every block of queries meets every block of vectors in a cell of a grid, and each cell has a bounded number of rows.
    # The keys have the same types on both sides, as equal numbers of different types are dealt out differently.
    q = q.withColumn("row", F.pmod(F.xxhash64("vec_id"), F.lit(rows)).cast("int")).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    v = v.withColumn("column", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(columns)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return empty
        dim = int(key[0])
        found = search_block(left["vec_id"].to_numpy(), _matrix(left["data"], dim), left["floor"].to_numpy(), right["vec_id"].to_numpy(), _matrix(right["data"], dim), k, bits)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64") if found else empty

    cell = ("dim", "row", "column")
    found = q.groupBy(*cell).cogroup(v.groupBy(*cell)).applyInPandas(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
