"""Whitening of vectors by a singular value decomposition of the centred rows.

Components become whole numbers, so sums and deviations are exact however rows are dealt out. The decomposition is that of Spark's distributed row matrix; its singular values are over the root of the sum of squares
and are rescaled by the number of rows. The total variance comes from the exact deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.workspace import Workspace

#: x = floor(SCALE * component) + SHIFT
SCALE, SHIFT = 1024, 100_000
#: Whole numbers beyond this are cut to it.
LAST = 1 << 62
ROWS = "vec_id long, dim int, x array<long>"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, x: whole components of the rows whose vector is there and all finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            flat = np.asarray(values.flatten().fill_null(np.nan)).astype(float)
            size = np.diff(np.asarray(values.offsets))
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            ends = np.cumsum(size)
            fit = bad[ends] == bad[ends - size]
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(SCALE * flat[np.repeat(fit, size)]), -float(LAST), float(LAST)).astype(np.int64) + SHIFT
            offsets = np.concatenate([[0], np.cumsum(size[fit])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fit)), pa.array(size[fit].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))], names=["vec_id", "dim", "x"])

    there = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return there.mapInArrow(run, ROWS)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index("x")).flatten()).reshape(-1, dim)


def sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length of vector: the number of rows and the exact sums by place, one row a place. A batch sends its sums, in two halves that can't overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, x = np.asarray(batch.column(0)), batch.column(1)
            for dim in np.unique(dims[dims > 0]).tolist():
                m = np.asarray(x.filter(pa.array(dims == dim)).flatten()).reshape(-1, dim)
                columns = [np.full(dim, dim, np.int32), np.arange(dim, dtype=np.int32), np.full(dim, len(m)), (m >> 32).sum(axis=0), (m & 0xFFFFFFFF).sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "place", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = rows.select("dim", "x").mapInArrow(run, "dim int, place int, n long, high long, low long").groupBy("dim", "place").agg(F.sum("n").alias("n"), exact("high"), exact("low")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found:
        out.setdefault(r["dim"], (r["n"], [0] * r["dim"]))[1][r["place"]] = (int(r["high"]) << 32) + int(r["low"])
    return out


def _offsets(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, exactly: as longs, or as Python's numbers where those could overflow."""
    if max(map(abs, s)) < 1 << 61 and (int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0) * n < 1 << 61:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def _squares(d: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if d.dtype != object and (not d.size or max(abs(int(d.max())), abs(int(d.min()))) < 1 << 46) and d.shape[1] < 1 << 14:
        high, low = d >> 24, d & 0xFFFFFF
        a, b, c = (high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)
        return [(p << 48) + (q << 25) + r for p, q, r in zip(a.tolist(), b.tolist(), c.tolist())]
    return [sum(v * v for v in row) for row in d.tolist()]


def components(rows: DataFrame, dim: int, n: int, s: list[int], k: int, whole_up_to: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns) of the covariance, divisor n, and their eigenvalues, falling: the first k, or fewer where the rest of the variance is zero.

    Vectors of up to whole_up_to components are decomposed as a whole, to double precision, from their dim x dim sums of products; longer ones by iterations.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = (_offsets(_matrix(batch, dim), n, s) / n).astype(float)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), dim).cast(pa.list_(pa.float64()))], names=["v"])

    vectors = rows.select("x").mapInArrow(centred, "v array<double>").select(array_to_vector("v").alias("v"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), n, dim).computeSVD(dim if dim <= whole_up_to else min(k, dim))
    values, v = np.asarray(svd.s.toArray())[:k], np.asarray(svd.V.toArray())[:, :k]
    return v, values**2 / n  # squares of singular values are sums over rows


def whitened(vectors: DataFrame, k: int = 8) -> DataFrame:
    """vec_id, component (1 to k), n, deviation, whitened, explained, identity_error for each row of vectors (vec_id, embedding) and each component.

    Rows whose vector is null or holds null or non-finite entries take no part; a null vec_id and repeated rows do. deviation is exact (decimal). Vectors of each length are whitened by themselves; one without
    components gives no row. A component without variance, as with one row, equal rows or fewer dimensions than k, has null whitened and is no part of identity_error; its share is null if there is no variance at all.
    Empty tables give no rows; other columns are ignored. What is collected: sums, a few numbers for each place of a vector, and the eigenvectors.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "whiten")
    rows = work.keep(whole_vectors(vectors), "rows")
    out = None
    for dim, (n, s) in sorted(sums(rows).items()):
        one = _whitened(work, rows.where(F.col("dim") == dim), dim, n, s, k)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double") if out is None else out


def _whitened(work: Workspace, rows: DataFrame, dim: int, n: int, s: list[int], k: int) -> DataFrame:
    m, (v, e) = min(k, dim), (np.zeros((dim, 0)), np.zeros(0))
    varies = rows.select("x").where(F.col("x") != F.array(*(F.lit(c) for c in rows.select("x").first()[0]))).limit(1).collect()
    if varies:
        v, e = components(rows, dim, n, s, k)
    turn = v / np.sqrt(e)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _offsets(_matrix(batch, dim), n, s)
            w = (d / n).astype(float) @ turn
            squares = _squares(d)
            deviation = pa.array([Decimal(x) if x < 10**38 else None for x in squares], pa.decimal128(38, 0))
            found = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), len(e)).cast(pa.list_(pa.float64())) if len(e) else pa.array([[]] * len(batch), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.array([float(x) for x in squares]), found], names=["vec_id", "deviation", "square", "w"])

    table = work.keep(rows.select("vec_id", "x").mapInArrow(place, "vec_id long, deviation decimal(38,0), square double, w array<double>"), f"placed{dim}")
    pairs = [(a, b) for a in range(len(e)) for b in range(a, len(e))]
    stats = table.agg(F.sum("square").alias("total"), *(F.covar_pop(F.col("w")[a], F.col("w")[b]).alias(f"c{a}_{b}") for a, b in pairs)).first()
    total = stats["total"] / n / n / n  # trace of the covariance
    error = max((abs(stats[f"c{a}_{b}"] - (a == b)) for a, b in pairs), default=0.0)
    each = F.explode(F.array(*(F.struct(F.lit(c + 1).alias("component"), (F.col("w")[c] if c < len(e) else F.lit(None).cast("double")).alias("whitened"), F.lit((float(e[c]) if c < len(e) else 0.0) / total if total else None).cast("double").alias("explained")) for c in range(m))))
    return table.select("vec_id", "deviation", each.alias("r")).select("vec_id", "r.component", F.lit(n).cast("long").alias("n"), "deviation", "r.whitened", "r.explained", F.lit(float(error)).alias("identity_error"))
