"""Evidential pair classifier: features of pairs, training on all of them with numpy, a block of pairs a task, inference where the pairs lie."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.workspace import Workspace

SIZES = (256, 128, 2)
#: Pairs that are trained on one after another, bytes of their features at most, and numbers of a network that are averaged together.
BLOCK, BLOCK_BYTES, PIECE = 20_000, 32 << 20, 2048


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6, then the asymptotic series."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    while (low := x < 6).any():
        out -= np.where(low, 1 / x, 0)
        x = np.where(low, x + 1, x)
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def kl_to_uniform(alpha: np.ndarray) -> np.ndarray:
    """Divergence of Dirichlet distributions (rows) from the uniform one."""
    k, s = alpha.shape[1], alpha.sum(axis=1)
    return _lgamma(s) - _lgamma(alpha).sum(axis=1) - math.lgamma(k) + ((alpha - 1) * (digamma(alpha) - digamma(s)[:, None])).sum(axis=1)


class Network:
    """Layers of rectified units; softplus of the last gives evidence, and alpha = evidence + 1."""

    def __init__(self, dim: int, seed: int = 42, sizes: tuple[int, ...] = SIZES):
        rng = np.random.default_rng(seed)
        ends = (dim, *sizes)
        self.w = [rng.normal(0, math.sqrt(2 / a), (a, b)) for a, b in zip(ends, ends[1:])]
        self.b = [np.zeros(b) for b in sizes]
        self.mean, self.sd = np.zeros(dim), np.ones(dim)

    def forward(self, x: np.ndarray, mask: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """Outputs of the layers, and alpha. mask: factors on the first layer's units, for dropout."""
        h = [(x - self.mean) / self.sd]
        for k, (w, b) in enumerate(zip(self.w, self.b)):
            z = h[-1] @ w + b
            z = np.maximum(z, 0) if k < len(self.w) - 1 else z
            h.append(z * mask if mask is not None and k == 0 else z)
        return h, np.logaddexp(0, h[-1]) + 1

    def uncertainty(self, x: np.ndarray, smooth: float = 0.1, scale: float = 1.0) -> np.ndarray:
        evidence = self.forward(x)[1] - 1
        return 2 / (evidence * scale + 1 + smooth).sum(axis=1)


def train(x: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 1e-3, batch: int = 256, kl_weight: float = 0.1, seed: int = 42, sizes: tuple[int, ...] = SIZES, dropout: float = 0.2, hard: float = 0.0) -> Network:
    """Expected squared error plus variance, and the divergence of misleading evidence with a weight that grows over the first ten epochs; Adam.

    dropout: share of the first layer's units that are left out in a step. hard: weight of the same loss over the batch's negative pairs (y = 0), added to it.
    """
    net = Network(x.shape[1], seed, sizes)
    if len(x):
        net.mean, net.sd = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    rng, state = np.random.default_rng(seed), _Adam(net)
    for epoch in range(epochs):
        _epoch(net, state, x, y, rng, epoch, rate, batch, kl_weight, dropout, hard)
    return net


class _Adam:
    """Moments of the gradients of a network's layers, and the steps done."""

    def __init__(self, net: Network):
        self.m, self.v = ([np.zeros_like(p) for p in (*net.w, *net.b)] for _ in range(2))
        self.t = 0


def _epoch(net: Network, state: _Adam, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epoch: int, rate: float = 1e-3, batch: int = 256, kl_weight: float = 0.1, dropout: float = 0.2, hard: float = 0.0) -> None:
    """All pairs once, in the order that rng gives; net and state are changed."""
    params, target, weight = [*net.w, *net.b], np.eye(2)[y.astype(int)], kl_weight * min(1.0, epoch / 10)
    order = rng.permutation(len(x))
    for lo in range(0, len(x), batch):
        at = order[lo : lo + batch]
        mask = (rng.random((len(at), net.w[0].shape[1])) >= dropout) / (1 - dropout) if dropout and len(net.w) > 1 else None
        share = np.full(len(at), 1 / len(at))
        negative = y[at] == 0
        if hard and negative.any():
            share = share + hard * negative / negative.sum()
        grads = _gradients(net, x[at], target[at], weight, share, mask)
        state.t += 1
        for k, g in enumerate(grads):
            state.m[k] = 0.9 * state.m[k] + 0.1 * g
            state.v[k] = 0.999 * state.v[k] + 0.001 * g * g
            params[k] -= rate * (state.m[k] / (1 - 0.9**state.t)) / (np.sqrt(state.v[k] / (1 - 0.999**state.t)) + 1e-8)


def loss(net: Network, x: np.ndarray, target: np.ndarray, weight: float) -> float:
    alpha = net.forward(x)[1]
    s = alpha.sum(axis=1, keepdims=True)
    p = alpha / s
    misled = target + (1 - target) * alpha
    return float((((target - p) ** 2).sum(axis=1) + (p * (1 - p) / (s + 1)).sum(axis=1) + weight * kl_to_uniform(misled)).mean())


def _trigamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    while (low := x < 6).any():
        out += np.where(low, 1 / x**2, 0)
        x = np.where(low, x + 1, x)
    return out + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)


def _gradients(net: Network, x: np.ndarray, target: np.ndarray, weight: float, share: np.ndarray | None = None, mask: np.ndarray | None = None) -> list[np.ndarray]:
    """Of the loss, whose rows count by `share` (evenly without it)."""
    share = np.full(len(x), 1 / len(x)) if share is None else share
    h, alpha = net.forward(x, mask)
    s = alpha.sum(axis=1, keepdims=True)
    p = alpha / s
    # d p_c / d alpha_k = (delta - p_c) / s
    dp = 2 * (p - target) + (1 - 2 * p) / (s + 1)
    d_alpha = (dp - (dp * p).sum(axis=1, keepdims=True)) / s - (p * (1 - p)).sum(axis=1, keepdims=True) / (s + 1) ** 2
    misled = target + (1 - target) * alpha
    total = misled.sum(axis=1, keepdims=True)
    d_kl = (misled - 1) * _trigamma(misled) - _trigamma(total) * (misled - 1).sum(axis=1, keepdims=True)
    d = (d_alpha + weight * d_kl * (1 - target)) * share[:, None] / (1 + np.exp(-h[-1]))
    gw, gb = [], []
    for k in range(len(net.w) - 1, -1, -1):
        gw.append(h[k].T @ d)
        gb.append(d.sum(axis=0))
        if k:
            d = (d @ net.w[k].T) * (h[k] > 0)
            if k == 1 and mask is not None:
                d = d * mask
    return [*gw[::-1], *gb[::-1]]


def pair_features(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (i, j, and four similarities struct, sem, temp, fused) with x: both vectors, then the four. vectors: n, e (array<double>)."""
    a, b = vectors.select(F.col("n").alias("i"), F.col("e").alias("ea")), vectors.select(F.col("n").alias("j"), F.col("e").alias("eb"))
    x = F.concat("ea", "eb", F.array(*(F.col(c).cast("double") for c in ("struct", "sem", "temp", "fused"))))
    return pairs.join(a, "i").join(b, "j").withColumn("x", x).drop("ea", "eb")


def infer(features: DataFrame, net: Network, smooth: float = 0.1) -> DataFrame:
    """i, j, v: uncertainty of each pair (i, j, x)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"i": f["i"], "j": f["j"], "v": net.uncertainty(np.stack(f["x"].to_list()), smooth)})

    kind = features.schema["i"].dataType.simpleString()
    return features.select("i", "j", "x").mapInPandas(run, f"i {kind}, j {kind}, v double")


def smoothing_sensitivity(features: DataFrame, net: Network, smooths: tuple[float, ...] = (0.0, 0.05, 0.1, 0.2, 0.5), floor: float = 0.5) -> DataFrame:
    """smooth, mean, sd, certain: the uncertainties of all pairs under each smoothing, and the share of them below `floor`. Pairs are read once for each."""
    out = None
    for s in smooths:
        one = infer(features, net, s).agg(F.lit(float(s)).alias("smooth"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.avg((F.col("v") < floor).cast("double")).alias("certain"))
        out = one if out is None else out.union(one)
    return out


def _flat(net: Network, state: _Adam) -> np.ndarray:
    """Layers and moments as one row of numbers."""
    return np.concatenate([p.ravel() for p in (*net.w, *net.b, *state.m, *state.v)])


def _unflat(net: Network, state: _Adam, flat: np.ndarray) -> None:
    """Into net and state, as copies."""
    at = 0
    for held in (net.w, net.b, state.m, state.v):
        for k, p in enumerate(held):
            held[k] = flat[at : at + p.size].reshape(p.shape).copy()
            at += p.size


def _packed(features: DataFrame, blocks: int, seed: int) -> DataFrame:
    """block, n, x, y, mean, m2: the pairs (i, j, x, y) that a hash deals to each block as one row, in the order of i, j, with each component's mean and squared deviations."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("i", "ascending"), ("j", "ascending")])
        x = np.asarray(t["x"].combine_chunks().flatten()).astype(float).reshape(len(t), -1)
        mean, y = x.mean(axis=0), np.asarray(t["y"]).astype(np.int8)
        row = {"block": t["block"][0].as_py(), "n": len(t), "x": x.tobytes(), "y": y.tobytes(), "mean": mean.tolist(), "m2": ((x - mean) ** 2).sum(axis=0).tolist()}
        return pa.Table.from_pylist([row], pa.schema([("block", pa.int32()), ("n", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))]))

    dealt = features.select(F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(blocks)).cast("int").alias("block"), "i", "j", "x", "y")
    return dealt.repartition(blocks, "block").groupBy("block").applyInArrow(pack, "block int, n long, x binary, y binary, mean array<double>, m2 array<double>")


def _moments(packed: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each component over the pairs of all blocks; blocks are added up in their order, so reruns agree."""

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        n, mean, m2 = (np.asarray(t[c]) for c in ("n", "mean", "m2"))
        of_all = (n * mean).sum() / n.sum()
        sd = math.sqrt((m2 + n * (mean - of_all) ** 2).sum() / n.sum())
        return pa.table({"k": t["k"].slice(0, 1), "mean": [of_all], "sd": [sd]})

    each = packed.select("block", "n", F.posexplode(F.arrays_zip("mean", "m2")).alias("k", "s")).select("block", "n", "k", "s.mean", "s.m2")
    rows = {r["k"]: r for r in each.groupBy("k").applyInArrow(add, "k int, mean double, sd double").collect()}  # a row for each component
    return np.array([rows[k]["mean"] for k in range(dim)]), np.array([rows[k]["sd"] or 1.0 for k in range(dim)])


def train_all(features: DataFrame, epochs: int = 30, seed: int = 42, sizes: tuple[int, ...] = SIZES, block: int = BLOCK, **settings) -> Network:
    """Fit on all pairs (i, j, x, y). They are read several times, so they should be a table.

    Up to `block` pairs are trained on one after another. More are dealt to blocks of about as many, and each block is an epoch's steps from the same network; the network and the moments it goes on from are the means of what the blocks end with, by their pairs.
    So every pair counts in every epoch. The result doesn't depend on how blocks are dealt to tasks, and only networks come to the driver.
    """
    have = features.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).first()
    dim = have["dim"] or 1
    each = max(1, min(block, BLOCK_BYTES // (8 * dim)))
    if have["n"] <= each:
        rows = features.orderBy(F.xxhash64("i", "j", F.lit(seed)), "i", "j").select("x", "y").collect()
        return train(np.array([r["x"] for r in rows], float).reshape(len(rows), dim), np.array([r["y"] for r in rows], int), epochs=epochs, seed=seed, sizes=sizes, **settings)
    blocks = -(-have["n"] // each)
    work = Workspace(features.sparkSession, "train")
    packed = work.keep(_packed(features, blocks, seed), "packed")
    net = Network(dim, seed, sizes)
    net.mean, net.sd = _moments(packed, dim)
    state = _Adam(net)
    for epoch in range(epochs):
        flat, state.t = _mean_epoch(packed, net, state, epoch, seed, settings)
        _unflat(net, state, flat)
    work.drop("packed")
    return net


def _mean_epoch(packed: DataFrame, net: Network, state: _Adam, epoch: int, seed: int, settings: dict) -> tuple[np.ndarray, int]:
    """What the blocks' networks and moments are in the mean after an epoch, by their pairs, and the most steps of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, steps = _flat(net, state), state.t
        for b in batches:
            for block, n, x, y in zip(*(b.column(c) for c in ("block", "n", "x", "y"))):
                _unflat(net, state, start)
                state.t = steps
                block, n = block.as_py(), n.as_py()
                _epoch(net, state, np.frombuffer(x.as_buffer()).reshape(n, -1), np.frombuffer(y.as_buffer(), np.int8), np.random.default_rng((seed, epoch, block)), epoch, **settings)
                flat = _flat(net, state)
                pieces = [flat[at : at + PIECE].tobytes() for at in range(0, len(flat), PIECE)]
                same = lambda v, kind: pa.array([v] * len(pieces), kind)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), same(block, pa.int32()), same(n, pa.int64()), same(state.t, pa.int64()), pa.array(pieces, pa.binary())], names=["k", "block", "n", "t", "w"])

    def mean(t: pa.Table) -> pa.Table:
        total = 0.0
        t = t.sort_by("block")
        for n, w in zip(t["n"], t["w"]):
            total = total + n.as_py() * np.frombuffer(w.as_buffer())
        return pa.table({"k": t["k"].slice(0, 1), "t": [max(t["t"].to_pylist())], "w": pa.array([(total / sum(t["n"].to_pylist())).tobytes()], pa.binary())})

    parts = packed.select("block", "n", "x", "y").mapInArrow(run, "k int, block int, n long, t long, w binary")
    rows = sorted(parts.groupBy("k").applyInArrow(mean, "k int, t long, w binary").collect())  # one network, its moments
    return np.concatenate([np.frombuffer(r["w"]) for r in rows]), rows[0]["t"]


def standardised(rows: DataFrame, column: str = "x") -> DataFrame:
    """rows with each component of an array column less its mean and over its population deviation (1 where that is 0), both over all rows."""
    stats = rows.select(F.posexplode(column).alias("k", "_x")).groupBy("k").agg(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s"))
    listed = stats.agg(F.array_sort(F.collect_list(F.struct("k", "m", "s"))).alias("_stats"))  # one row, a component each
    scaled = F.zip_with(column, "_stats", lambda x, t: (x - t["m"]) / F.when(t["s"] > 0, t["s"]).otherwise(F.lit(1.0)))
    return rows.join(F.broadcast(listed)).withColumn(column, scaled).drop("_stats")


def save(spark, net: Network, path: str) -> None:
    """A network's layers and its scaler as a table."""
    arrays = [("mean", 0, net.mean), ("sd", 0, net.sd), *(("w", k, w) for k, w in enumerate(net.w)), *(("b", k, b) for k, b in enumerate(net.b))]
    rows = [(name, k, list(a.shape), a.ravel().tolist()) for name, k, a in arrays]
    spark.createDataFrame(rows, "name string, k int, shape array<int>, data array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Network:
    held = {(r["name"], r["k"]): np.array(r["data"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}  # a row for each array of the network
    n = sum(name == "w" for name, _ in held)
    net = Network(len(held["mean", 0]), sizes=tuple(held["w", k].shape[1] for k in range(n)))
    net.w, net.b, net.mean, net.sd = [held["w", k] for k in range(n)], [held["b", k] for k in range(n)], held["mean", 0], held["sd", 0]
    return net
