"""Spectral clustering of graphs of any size: block power iterations over the table of links, then a rotation that makes the embedding discrete.

A node's row is k numbers and a few more. Between passes only sums of products come to the driver, (k + SPARE)^2 numbers, whatever the number of nodes is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.workspace import Workspace

#: Nodes of a graph that one task embeds by itself, with a matrix of at most eight megabytes.
DENSE = 1024
#: Columns beyond the k that are asked for; the k come the faster for them.
SPARE = 4


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _next_rotation(sums: np.ndarray) -> tuple[np.ndarray, float]:
    """The rotation nearest to the sums of rows by cluster, and how well it fits."""
    u, s, vh = np.linalg.svd(sums)
    return vh.T @ u.T, float(s.sum())


def discrete(x: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Cluster (0 to k - 1) of each row of an embedding: a rotation is turned until rows and unit vectors fit best. It starts from the first row and those most across to the rows before."""
    x, k = _unit(x), x.shape[1]
    start, across = [x[0]], np.zeros(len(x))
    while len(start) < k:
        across += abs(x @ start[-1])
        start.append(x[across.argmin()])
    turn, last = np.array(start).T, -np.inf
    for _ in range(rounds):
        label = (x @ turn).argmax(axis=1)
        turn_next, fit = _next_rotation(np.stack([x[label == c].sum(axis=0) for c in range(k)]))
        if fit - last < 1e-9:
            break
        turn, last = turn_next, fit
    return label


def _dense(k: int, kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([pdf["i"], pdf["j"]]), return_inverse=True)
        w = np.zeros((len(names), len(names)))
        i, j = at[: len(pdf)], at[len(pdf) :]
        w[i, j] = w[j, i] = pdf["v"]
        z = 1 / np.sqrt(w.sum(axis=1))
        x = np.linalg.eigh(z[:, None] * w * z)[1][:, ::-1][:, : min(k, len(names))]
        label = discrete(x * z[:, None])
        first = {c: names[np.flatnonzero(label == c)[0]] for c in set(label.tolist())}
        return pd.DataFrame({"n": names, "cluster": [first[c] for c in label.tolist()]})

    return run


def spectral(sim: DataFrame, k: int, dense: int = DENSE, tolerance: float = 1e-5, rounds: int = 150) -> DataFrame:
    """n, cluster (its least node): k clusters of the graph (i, j, v), from the k leading eigenvectors of its normalised links. A pair that stands several times counts with its largest weight; links of a node with itself don't count.

    Up to `dense` nodes are one task. Others go through tables: rows are multiplied by (1 + M) / 2, two times between orthonormalisations, until the eigenvalues that are asked for move by less than `tolerance`. Starts come from
    hashes and ties go to the least, so reruns agree but for signs and the last digits. No links: no rows.
    """
    spark = sim.sparkSession
    work = Workspace(spark, "spectral")
    kind = sim.schema["i"].dataType.simpleString()
    pairs = work.keep(sim.where("v > 0 and i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "v").groupBy("i", "j").agg(F.max("v").alias("v")), "pairs")
    both = pairs.union(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    degrees = work.keep(both.groupBy(F.col("i").alias("n")).agg(F.sum("v").alias("deg")), "degrees")
    nodes = degrees.count()
    if nodes <= max(dense, k):
        return pairs.groupBy(F.lit(1).alias("_one")).applyInPandas(_dense(k, kind), f"n {kind}, cluster {kind}")
    end = lambda n: degrees.select(F.col("n").alias(n), F.col("deg").alias(f"d{n}"))
    links = work.keep(both.join(end("i"), "i").join(end("j"), "j").select("i", "j", (F.col("v") / F.sqrt(F.col("di") * F.col("dj")) / 2).alias("w")), "links")
    width = k + SPARE
    cols = [f"x{c}" for c in range(width)]
    schema = f"n {kind}, " + ", ".join(f"{c} double" for c in cols)

    def times(x: DataFrame) -> DataFrame:
        """(1 + M) / 2 times x; a hub's rows are split by the adaptive join."""
        own = x.select("n", *((F.col(c) / 2).alias(c) for c in cols))
        near = links.join(x.withColumnRenamed("n", "j"), "j").select(F.col("i").alias("n"), *((F.col("w") * F.col(c)).alias(c) for c in cols))
        return own.union(near).groupBy("n").agg(*(F.sum(c).alias(c) for c in cols))

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([np.asarray(batch.column(c)) for c in range(1, batch.num_columns)], axis=1)

    def summed(x: DataFrame, part, shape: tuple[int, int]) -> np.ndarray:
        """The sum of part(rows) over all rows, an array of that shape."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                total += part(matrix(batch))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

        out = np.zeros(shape)
        for r in x.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out.ravel()[r["at"]] = r["v"]
        return out

    def mapped(x: DataFrame, by: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = matrix(batch) @ by
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, y.T)], names=["n", *cols])

        return x.mapInArrow(run, schema)

    x = degrees.select("n", *((F.pmod(F.xxhash64("n", F.lit(c)), F.lit(1 << 20)) / (1 << 19) - 1).alias(f"x{c}") for c in range(width)))
    values = np.zeros(k)
    for step in range(rounds):
        y = work.keep(times(times(x)), f"y{step}")
        s, u = np.linalg.eigh(summed(y, lambda m: m.T @ m, (width, width)))
        s, u = np.maximum(s[::-1], 1e-300), u[:, ::-1]
        if step:
            work.drop(f"y{step - 1}")
        # Squares of the squares of the eigenvalues of (1 + M) / 2, once x has orthonormal columns.
        now = s[:k] ** 0.25
        x = mapped(y, u / np.sqrt(s))
        if step > 1 and abs(now - values).max() < tolerance:
            break
        values = now
    scaled = mapped(work.keep(x, "vectors"), np.eye(width)).join(degrees, "n").select("n", *((F.col(c) / F.sqrt("deg")).alias(c) for c in cols[:k]))
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in cols[:k]), F.lit(0.0)))
    rows = work.keep(scaled.withColumn("z", F.greatest(size, F.lit(1e-12))).select("n", *((F.col(c) / F.col("z")).alias(c) for c in cols[:k])), "rows")
    dot = lambda row: F.abs(sum((F.col(c) * float(v) for c, v in zip(cols, row)), F.lit(0.0)))
    start = [list(rows.orderBy("n").limit(1).first())[1:]]
    while len(start) < k:
        start.append(list(rows.orderBy(F.round(sum((dot(r) for r in start), F.lit(0.0)), 9), "n").limit(1).first())[1:])
    turn, last = np.array(start).T, -np.inf
    for _ in range(30):
        sums = summed(rows, lambda m, t=turn: np.eye(k)[(m @ t).argmax(axis=1)].T @ m, (k, k))
        turn_next, fit = _next_rotation(sums)
        if fit - last < 1e-9 * nodes:
            break
        turn, last = turn_next, fit

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((matrix(batch) @ turn).argmax(axis=1))], names=["n", "c"])

    found = work.keep(rows.mapInArrow(label, f"n {kind}, c long"), "labels")
    return found.join(F.broadcast(found.groupBy("c").agg(F.min("n").alias("cluster"))), "c").select("n", "cluster")  # k rows
