"""Weighted fusion of modalities, damping by uncertainty, thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from seamline.functions import math
from seamline.operators import ranges


def fuse(parts: list[tuple[DataFrame, float]], renormalise: bool = True) -> DataFrame:
    """The weighted sum of matrices (i, j, v), clipped to 0 .. 1; absent pairs are zero. A modality that is missing altogether is one without rows."""
    total = sum(w for _, w in parts) if renormalise else 1.0
    rows = reduce(DataFrame.union, (df.select("i", "j", (F.col("v") * (w / total)).alias("v")) for df, w in parts))
    return rows.groupBy("i", "j").agg(math.clip(F.sum("v")).alias("v"))


def sweep(a: DataFrame, b: DataFrame, steps: int = 10) -> DataFrame:
    """mu, i, j, v: mu * a + (1 - mu) * b for mu = 0 .. 1. The grid is unrolled beside the pairs, which are joined once."""
    both = a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"], "full").fillna(0.0, ["x", "y"])
    mu = F.explode(F.array(*(F.lit(k / steps) for k in range(steps + 1))))
    return both.withColumn("mu", mu).select("mu", "i", "j", (F.col("mu") * F.col("x") + (1 - F.col("mu")) * F.col("y")).alias("v"))


def disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, v: the absolute difference of two matrices."""
    both = a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"], "full").fillna(0.0, ["x", "y"])
    return both.select("i", "j", F.abs(F.col("x") - F.col("y")).alias("v"))


def median_full(u: DataFrame, n: int) -> DataFrame:
    """One row m: the median over all n * n cells of a symmetric matrix with zero diagonal. Each pair counts twice; absent pairs are zero."""
    pairs = n * (n - 1) // 2
    cells = n * n
    counted = u.agg(F.count("*").alias("k"), F.sort_array(F.array(F.lit(0.0))).alias("z"))
    return _median_from(u.select("v"), counted, pairs, cells, n)


def _median_from(u: DataFrame, counted: DataFrame, pairs: int, cells: int, n: int) -> DataFrame:
    # Values with their weights, so no cell is made.
    zeros = counted.select(F.lit(0.0).alias("v"), (F.lit(n) + 2 * (F.lit(pairs) - F.col("k"))).cast("long").alias("w"))
    weighted = u.select("v", F.lit(2).cast("long").alias("w")).union(zeros).where("w > 0")
    return ranges.quantiles(weighted, [0.5], weight=F.col("w")).select(F.col("q")[0].alias("m"))


def damped(sim: DataFrame, u: DataFrame, n: int, mode: str, k: float = 2.0, power: float = 2.0, alpha: float = 15.0) -> DataFrame:
    """i, j, v: similarities damped by uncertainty, by mode exp, gate or sigmoid. The middle is the median of all cells of u."""
    both = sim.join(u.select("i", "j", F.col("v").alias("u")), ["i", "j"], "left").fillna(0.0, ["u"]).join(F.broadcast(median_full(u, n)))  # one row
    s, uu, m = F.col("v"), F.col("u"), F.col("m")
    v = {"exp": math.damp_exp(s, uu, k), "gate": math.damp_gate(s, uu, m, power), "sigmoid": math.damp_sigmoid(s, uu, alpha, m)}[mode]
    return both.select("i", "j", v.alias("v"))


def edge_threshold(sim: DataFrame, quantile: float = 0.7, cap: float = 0.02, diagonal: int = 0) -> DataFrame:
    """One row tau: the smaller of cap and a quantile of the positive cells, each pair twice and `diagonal` ones."""
    cells = sim.where("v > 0").select("v", F.lit(2).cast("long").alias("w"))
    if diagonal:
        cells = cells.union(sim.sparkSession.range(1).select(F.lit(1.0).alias("v"), F.lit(diagonal).cast("long").alias("w")))
    return ranges.quantiles(cells, [quantile], weight=F.col("w")).select(F.least(F.col("q")[0], F.lit(cap)).alias("tau"))


def suppressed(sim: DataFrame, damped_sim: DataFrame, strong: float = 0.1, left: float = 0.7) -> DataFrame:
    """strong, suppressed: pairs above `strong`, and those of them that damping leaves at most a share `left` of."""
    both = sim.select("i", "j", F.col("v").alias("s")).join(damped_sim.select("i", "j", F.col("v").alias("d")), ["i", "j"])
    return both.agg(F.count_if(F.col("s") > strong).alias("strong"), F.count_if((F.col("s") > strong) & (F.col("d") <= left * F.col("s"))).alias("suppressed"))


def boundary_pairs(sim: DataFrame, u: DataFrame, labels: DataFrame, s_least: float = 0.5, u_most: float = 0.3, top: int = 10) -> DataFrame:
    """The `top` pairs of different labels that are alike and certain: by similarity above the limit, then certainty, then i, j."""
    x = sim.join(u.select("i", "j", F.col("v").alias("u")), ["i", "j"]).where((F.col("v") > s_least) & (F.col("u") < u_most))
    x = x.join(labels.select(F.col("n").alias("i"), F.col("label").alias("li")), "i").join(labels.select(F.col("n").alias("j"), F.col("label").alias("lj")), "j")
    return x.where("li <> lj").orderBy(F.desc(F.round("v", 9)), F.round("u", 9), "i", "j").limit(top).select("i", "j", "v", "u")


def case_edges(sim: DataFrame, damped_sim: DataFrame, u: DataFrame, before: DataFrame, after: DataFrame, top: int = 10) -> DataFrame:
    """Pairs together in one partition (n, cluster) and apart in the other, by 2 * drop + s + u / 2."""
    x = sim.select("i", "j", F.col("v").alias("s")).join(damped_sim.select("i", "j", F.col("v").alias("d")), ["i", "j"]).join(u.select("i", "j", F.col("v").alias("u")), ["i", "j"])
    for name, p in (("b", before), ("a", after)):
        for side in ("i", "j"):
            x = x.join(p.select(F.col("n").alias(side), F.col("cluster").alias(f"{name}{side}")), side)
    x = x.where((F.col("bi") == F.col("bj")) != (F.col("ai") == F.col("aj")))
    x = x.withColumn("score", 2 * (F.col("s") - F.col("d")) + F.col("s") + 0.5 * F.col("u"))
    return x.orderBy(F.desc(F.round("score", 9)), "i", "j").limit(top).select("i", "j", F.when(F.col("bi") == F.col("bj"), "split").otherwise("merged").alias("change"), "score")


def deemphasised(sim: DataFrame, names: DataFrame, both: float = 0.6, one: float = 0.8) -> DataFrame:
    """Similarities times `both` between two data holders and times `one` between one and another class, clipped. names: n, entity (boolean)."""
    x = sim.join(names.select(F.col("n").alias("i"), F.col("entity").alias("_a")), "i").join(names.select(F.col("n").alias("j"), F.col("entity").alias("_b")), "j")
    factor = F.when(F.col("_a") & F.col("_b"), both).when(F.col("_a") | F.col("_b"), one).otherwise(1.0)
    return x.select("i", "j", math.clip(F.col("v") * factor).alias("v"))


def scaled(sim: DataFrame) -> DataFrame:
    """v scaled to 0 .. 1 over the cells of the whole matrix, of which absent ones are 0; no range gives zeros."""
    stats = sim.agg(F.least(F.min("v"), F.lit(0.0)).alias("low"), F.greatest(F.max("v"), F.lit(0.0)).alias("high"))
    wide = F.col("high") - F.col("low")
    return sim.join(F.broadcast(stats)).select("i", "j", F.when(wide > 0, (F.col("v") - F.col("low")) / wide).otherwise(F.lit(0.0)).alias("v"))  # one row


def call_mix(direct: DataFrame, indirect: DataFrame, share: float = 0.5) -> DataFrame:
    """Calls between classes by `share`, and similarity of what they call outside (scaled) by the rest. Where no call was matched directly, only the latter counts."""
    any_ = direct.limit(1).agg(F.count("*").alias("k"))  # one row
    known = lambda df, w: df.join(F.broadcast(any_)).select("i", "j", (F.col("v") * w).alias("v"))
    both = known(direct, F.lit(share)).union(known(scaled(indirect), F.when(F.col("k") > 0, 1 - share).otherwise(F.lit(1.0))))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


#: Weights of inheritance, dependencies, calls and packages; those of two systems differ.
STRUCTURAL = {"": (0.30, 0.30, 0.30, 0.10), "daytrader": (0.30, 0.15, 0.35, 0.20), "plants": (0.25, 0.15, 0.35, 0.25)}
#: The share of direct calls.
DIRECT = {"": 0.5, "daytrader": 0.7}


def structural(inherits: DataFrame, depends: DataFrame, calls: DataFrame, packages: DataFrame, system: str = "") -> DataFrame:
    """The four structural modalities (i, j, v), each scaled, by the system's weights."""
    weights = STRUCTURAL.get(system, STRUCTURAL[""])
    return fuse([(scaled(df), w) for df, w in zip((inherits, depends, calls, packages), weights)])
