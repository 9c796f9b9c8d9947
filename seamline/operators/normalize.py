"""Normalisation and summaries of similarity matrices in long form.

The matrices stand for full symmetric ones: a pair i < j counts twice, absent pairs are zero, and the diagonal has one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from seamline.functions.math import clip, sigmoid
from seamline.operators import ranges
from seamline.workspace import Workspace


def minmax(sim: DataFrame, diagonal: float | None = None, least_range: float = 1e-9) -> DataFrame:
    """v scaled to 0 .. 1 over all pairs given (and the diagonal); a range below least_range gives zeros."""
    low, high = F.min("v"), F.max("v")
    if diagonal is not None:
        low, high = F.least(low, F.lit(diagonal)), F.greatest(high, F.lit(diagonal))
    stats = sim.agg(low.alias("low"), high.alias("high"))
    scaled = F.when(F.col("high") - F.col("low") < least_range, F.lit(0.0)).otherwise((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")))
    return sim.join(F.broadcast(stats)).select("i", "j", scaled.alias("v"))  # one row


def quantile_ranks(sim: DataFrame) -> DataFrame:
    """v as its rank, evenly from 0 to 1; ties by i, j. Ranks come from counts by ranges, so no task sorts all pairs."""
    nth = ranges.ranked(sim.select("i", "j", "v"), [F.col("v"), F.col("i"), F.col("j")])
    every = sim.agg(F.count("*").alias("_all"))  # one row
    return nth.join(F.broadcast(every)).select("i", "j", F.when(F.col("_all") > 1, F.col("nth") / (F.col("_all") - 1)).otherwise(F.lit(0.0)).alias("v"))


def robust(sim: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """v scaled between two quantiles and clipped."""
    stats = ranges.quantiles(sim, [low, high]).select(F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    scaled = F.when(F.col("b") - F.col("a") < 1e-12, F.lit(0.0)).otherwise(clip((F.col("v") - F.col("a")) / (F.col("b") - F.col("a"))))
    return sim.join(F.broadcast(stats)).select("i", "j", scaled.alias("v"))  # one row


def row_top_k(full: DataFrame, k: int) -> DataFrame:
    """The k largest off the diagonal in each row (i), ties to the smaller j; the diagonal stays."""
    nth = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("v"), "j"))
    return full.where("i <> j").withColumn("_k", nth).where(F.col("_k") <= k).drop("_k").union(full.where("i = j"))


def knn_graph(full: DataFrame, k: int) -> DataFrame:
    """Pairs i < j of which either has the other among its k largest positive neighbours."""
    near = row_top_k(full.where("i <> j and v > 0"), k)
    return near.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "v").distinct()


def row_sigmoid(full: DataFrame) -> DataFrame:
    """Off-diagonal values as the sigmoid of their z-score in the row (population deviation plus 1e-6); the diagonal becomes 1."""
    row = Window.partitionBy("i")
    off = F.when(F.col("i") != F.col("j"), F.col("v"))
    z = (F.col("v") - F.avg(off).over(row)) / (F.stddev_pop(off).over(row) + 1e-6)
    return full.select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(sigmoid(z)).alias("v"))


def refine(full: DataFrame, target_mean: float = 0.5, top_k: int = 0) -> DataFrame:
    """The semantic refiner on a full matrix (both directions and the diagonal): row sigmoids, scaled over all cells, moved half-way to a mean, made sparse and symmetric; i < j come back."""
    # Written once: the scaling, its mean and the result are passes over a table, not over the windows.
    rows = Workspace(full.sparkSession, "refine").keep(row_sigmoid(full.select("i", "j", clip(F.col("v")).alias("v"))), "rows")
    scaled = minmax(rows)
    mean = scaled.agg(F.avg("v").alias("m"))
    moved = scaled.join(F.broadcast(mean)).select("i", "j", (0.5 * clip(F.col("v") * (target_mean / F.greatest("m", F.lit(1e-9)))) + 0.5 * F.col("v")).alias("v"))  # one row
    if top_k:
        moved = row_top_k(moved, top_k)
    off = moved.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "v")
    return off.groupBy("i", "j").agg((F.sum("v") / 2).alias("v"))  # a direction that is absent counts as zero


def summary(sim: DataFrame) -> DataFrame:
    """One row: count, mean, population deviation, quantiles and shares of large values."""
    q = ranges.quantiles(sim, [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])
    row = sim.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), *(F.avg((F.col("v") >= c).cast("double")).alias(f"share_{int(c * 100)}") for c in (0.5, 0.8, 0.9)))
    row = row.join(F.broadcast(q))  # one row each
    return row.select("n", "mean", "sd", *(F.col("q")[i].alias(name) for i, name in enumerate(("q0", "q5", "q25", "q50", "q75", "q95", "q100"))), "share_50", "share_80", "share_90")


def histogram(df: DataFrame, by: list[str], bins: int = 60) -> DataFrame:
    """Density of v over equal bins of 0 .. 1 for each `by`; the last bin is closed."""
    cell = F.least(F.floor(F.col("v") * bins), F.lit(bins - 1)).cast("int")
    counts = df.where("v between 0 and 1").groupBy(*by, cell.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") * bins / F.sum("n").over(Window.partitionBy(*by)))


def intra_inter(sim: DataFrame, labels: DataFrame, nonzero: bool = False) -> DataFrame:
    """Mean similarity within and between labels (n, label; negative ones are out) and their ratio."""
    known = labels.where("label >= 0")
    x = sim.join(known.select(F.col("n").alias("i"), F.col("label").alias("li")), "i").join(known.select(F.col("n").alias("j"), F.col("label").alias("lj")), "j")
    if nonzero:
        x = x.where("v > 0")
    same = F.col("li") == F.col("lj")
    out = x.agg(F.avg(F.when(same, F.col("v"))).alias("intra"), F.avg(F.when(~same, F.col("v"))).alias("inter"), F.count_if(same).alias("n_intra"), F.count_if(~same).alias("n_inter"))
    return out.withColumn("ratio", F.when(F.col("inter") != 0, F.col("intra") / F.col("inter")))


def difference(a: DataFrame, b: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Changed pairs and the L1, L2 and largest difference of two matrices; absent pairs are zero."""
    both = a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"], "full")
    d: Column = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return both.agg(F.count_if(d > eps).alias("changed"), F.sum(d).alias("l1"), F.sqrt(F.sum(d * d)).alias("l2"), F.max(d).alias("linf"))
