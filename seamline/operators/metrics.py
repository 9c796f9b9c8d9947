"""Quality of clusterings, from contingency counts: no pair of nodes is ever formed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seamline.workspace import Workspace


def contingency(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """p, t, n: common nodes for each pair of predicted and true cluster. pred and truth: n, cluster."""
    both = pred.select("n", F.col("cluster").alias("p")).join(truth.select("n", F.col("cluster").alias("t")), "n")
    return both.groupBy("p", "t").agg(F.count("*").alias("c"))


def _totals(table: DataFrame) -> DataFrame:
    p = table.groupBy("p").agg(F.sum("c").alias("cp"))
    t = table.groupBy("t").agg(F.sum("c").alias("ct"))
    return table.join(p, "p").join(t, "t")


def _f1(p, r):
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def pairwise_f1(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """precision, recall, f1 over pairs in one cluster; 0 where nothing divides."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    table = contingency(pred, truth)
    tp = table.agg(F.coalesce(two("c"), F.lit(0.0)).alias("tp"))
    pp = table.groupBy("p").agg(F.sum("c").alias("c")).agg(F.coalesce(two("c"), F.lit(0.0)).alias("pp"))
    tt = table.groupBy("t").agg(F.sum("c").alias("c")).agg(F.coalesce(two("c"), F.lit(0.0)).alias("tt"))
    row = tp.join(F.broadcast(pp)).join(F.broadcast(tt))  # one row each
    share = lambda of: F.when(F.col(of) > 0, F.col("tp") / F.col(of)).otherwise(F.lit(0.0))
    row = row.select(share("pp").alias("precision"), share("tt").alias("recall"))
    return row.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def bcubed(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """precision, recall, f1, averaged over nodes."""
    x = _totals(contingency(pred, truth))
    row = x.agg((F.sum(F.col("c") * F.col("c") / F.col("cp")) / F.sum("c")).alias("precision"), (F.sum(F.col("c") * F.col("c") / F.col("ct")) / F.sum("c")).alias("recall"))
    return row.select(F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("recall", F.lit(0.0)).alias("recall")).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


#: Rows of a contingency table that one task may well hold.
LIGHT = 1 << 16


def mojo(pred: DataFrame, truth: DataFrame, light: int = LIGHT, by: tuple[str, ...] = ()) -> DataFrame:
    """by, moves, n, mojosim: predicted clusters by size (then id) take the unused true cluster they share most with (then the smaller id); the rest moves. by: columns of pred that tell partitions apart.

    Every predicted cluster asks for the best true one that hasn't refused it, and that keeps the first in order of those that ask and refuses all behind it for good; rounds go on until nobody is refused. That ends as taking
    in order does, since all true clusters want the same. Once `light` rows are left, a task for each partition goes through them in order. No common nodes: no row.
    """
    return _mojo(_contingency(pred, truth, by), light, by)


def _contingency(pred: DataFrame, truth: DataFrame, by: tuple[str, ...]) -> DataFrame:
    both = pred.select(*by, "n", F.col("cluster").alias("p")).join(truth.select("n", F.col("cluster").alias("t")), "n")
    return both.groupBy(*by, "p", "t").agg(F.count("*").alias("c"))


def _mojo(x: DataFrame, light: int, by: tuple[str, ...]) -> DataFrame:
    work = Workspace(x.sparkSession, "mojo")
    table, step = work.keep(x.join(x.groupBy(*by, "p").agg(F.sum("c").alias("cp")), [*by, "p"]).select(*by, "p", "t", "c", (-F.col("cp")).alias("late")), "table0"), 0
    totals = work.keep(table.groupBy(*by).agg(F.sum("c").alias("n")).where("n is not null"), "totals")
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in table.schema if f.name in (*by, "p", "t")) + "c long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, kept, key = set(), [], pdf[list(by)].iloc[0].tolist()
        for _, rows in pdf.sort_values(["late", "p", "c", "t"], ascending=[True, True, False, True]).groupby(["late", "p"], sort=True):
            took = next(((t, c) for t, c in zip(rows["t"], rows["c"]) if t not in used), None)
            if took:
                used.add(took[0])
                kept.append((*key, rows["p"].iloc[0], *took))
        return pd.DataFrame(kept, columns=[*by, "p", "t", "c"])

    while True:
        if table.count() <= light:
            kept = table.groupBy(*(by or [F.lit(1).alias("_one")])).applyInPandas(run, schema)
            break
        asks = table.groupBy(*by, "p", "late").agg(F.min(F.struct((-F.col("c")).alias("c"), "t")).alias("best")).select(*by, "p", "late", "best.t", (-F.col("best.c")).alias("c"))
        asks = work.keep(asks, f"asks{step}")
        holds = asks.groupBy(*by, "t").agg(F.min(F.struct("late", "p")).alias("holder"), F.count("*").alias("asking"))
        if not holds.where("asking > 1").limit(1).collect():
            kept = asks
            break
        left = table.join(holds.drop("asking"), [*by, "t"], "left").where(F.col("holder").isNull() | (F.struct("late", "p") <= F.col("holder")))
        step += 1
        table = work.keep(left.select(*by, "p", "t", "c", "late"), f"table{step}")
        work.drop(f"table{step - 1}")
    sums = kept.groupBy(*by).agg(F.sum("c").alias("kept"))
    rows = totals.join(sums, list(by)) if by else totals.join(F.broadcast(sums))  # one row each
    return rows.select(*by, (F.col("n") - F.col("kept")).cast("long").alias("moves"), F.col("n").cast("long").alias("n"), ((1 - (F.col("n") - F.col("kept")) / F.col("n")) * 100).alias("mojosim"))


def measures(parts: DataFrame, truth: DataFrame, deps: DataFrame, by: tuple[str, ...], light: int = LIGHT) -> DataFrame:
    """by, k, gt_k, k_diff, bcubed, pairwise, mojosim, ifn, icp, ned, sm: all figures of a table of results, for all partitions (by, n, cluster) at once.

    truth: n, cluster; deps: source, target, w. Accuracy is over the nodes that both have, coupling over the edges both of whose ends have a cluster; without any of those a figure is null. ned and sm as ned() and structural_modularity().
    A null in `by` tells no partition.
    """
    work = Workspace(parts.sparkSession, "measures")
    parts = work.keep(parts.select(*by, "n", "cluster"), "parts")
    keys = list(by)
    cells = work.keep(_contingency(parts, truth, by), "cells")
    p, t = cells.groupBy(*by, "p").agg(F.sum("c").alias("cp")), cells.groupBy(*by, "t").agg(F.sum("c").alias("ct"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    whole = cells.join(p, [*by, "p"]).join(t, [*by, "t"]).groupBy(*by).agg(
        (F.sum(F.col("c") * F.col("c") / F.col("cp")) / F.sum("c")).alias("bp"), (F.sum(F.col("c") * F.col("c") / F.col("ct")) / F.sum("c")).alias("br"), pairs("c").alias("tp"), F.count_distinct("p").alias("k_common"), F.count_distinct("t").alias("gt_k")
    )
    whole = whole.join(p.groupBy(*by).agg(pairs("cp").alias("pp")), keys).join(t.groupBy(*by).agg(pairs("ct").alias("tt")), keys)
    share = lambda of: F.when(F.col(of) > 0, F.col("tp") / F.col(of)).otherwise(F.lit(0.0))
    accuracy = whole.select(*by, "gt_k", (F.col("k_common") - F.col("gt_k")).alias("k_diff"), _f1(F.col("bp"), F.col("br")).alias("bcubed"), _f1(share("pp"), share("tt")).alias("pairwise"))
    sizes = work.keep(parts.groupBy(*by, "cluster").agg(F.count("*").alias("size")), "sizes")
    spread = sizes.groupBy(*by).agg(F.count("*").alias("k"), F.coalesce(F.stddev_pop("size") / F.avg("size"), F.lit(0.0)).alias("ned"), F.sum("size").alias("nodes"))
    crossed = work.keep(deps.join(parts.select(*by, F.col("n").alias("source"), F.col("cluster").alias("cs")), "source").join(parts.select(*by, F.col("n").alias("target"), F.col("cluster").alias("ct")), [*by, "target"]).groupBy(*by, "cs", "ct", (F.col("source") == F.col("target")).alias("loop")).agg(F.sum("w").alias("w"), F.count("*").alias("edges")), "crossed")
    apart = F.col("cs") != F.col("ct")
    coupled = crossed.groupBy(*by).agg(F.sum(F.when(apart, F.col("w")).otherwise(0)).cast("double").alias("ifn"), (F.sum(F.when(apart, F.col("edges")).otherwise(0)) / F.sum("edges")).alias("icp"))
    flows = crossed.where("not loop").groupBy(*by, F.col("cs").alias("cluster")).agg(F.sum(F.when(apart, 0).otherwise(F.col("w"))).alias("inside"), F.sum(F.when(apart, F.col("w")).otherwise(0)).alias("outside"))
    each = sizes.join(flows, [*by, "cluster"], "left").fillna(0, ["inside", "outside"]).join(spread, keys)
    others = F.col("nodes") - F.col("size")
    cohesion = F.when(F.col("size") > 1, F.col("inside") / (F.col("size") * (F.col("size") - 1))).otherwise(F.lit(0.0))
    out = F.when(others > 0, F.col("outside") / (F.col("size") * others)).otherwise(F.lit(0.0))
    shape = each.groupBy(*by).agg(F.when(F.max("k") > 1, F.avg(cohesion) - F.avg(out)).otherwise(F.lit(0.0)).alias("sm"))
    found = spread.drop("nodes").join(shape, keys).join(accuracy, keys, "left").join(_mojo(cells, light, by).select(*by, "mojosim"), keys, "left").join(coupled, keys, "left")
    return found.select(*by, "k", "gt_k", "k_diff", "bcubed", "pairwise", "mojosim", "ifn", "icp", "ned", "sm")


def _crossed(deps: DataFrame, part: DataFrame) -> DataFrame:
    a = part.select(F.col("n").alias("source"), F.col("cluster").alias("cs"))
    b = part.select(F.col("n").alias("target"), F.col("cluster").alias("ct"))
    return deps.join(a, "source").join(b, "target")


def coupling(deps: DataFrame, part: DataFrame) -> DataFrame:
    """ifn (weight of calls across clusters), icp (share of edges across). deps: source, target, w."""
    x = F.col("cs") != F.col("ct")
    row = _crossed(deps, part).agg(F.coalesce(F.sum(F.when(x, F.col("w")).otherwise(0)), F.lit(0)).cast("double").alias("ifn"), F.count_if(x).alias("_x"), F.count("*").alias("_all"))
    return row.select("ifn", F.when(F.col("_all") > 0, F.col("_x") / F.col("_all")).otherwise(F.lit(0.0)).alias("icp"))


def ned(part: DataFrame) -> DataFrame:
    """k, ned: number of clusters, and population deviation over mean of their sizes."""
    sizes = part.groupBy("cluster").agg(F.count("*").alias("c"))
    return sizes.agg(F.count("*").alias("k"), F.coalesce(F.stddev_pop("c") / F.avg("c"), F.lit(0.0)).alias("ned"))


def structural_modularity(deps: DataFrame, part: DataFrame) -> DataFrame:
    """cohesion, coupling, sm: mean over clusters, those without edges included; all 0 for at most one cluster."""
    sizes = part.groupBy("cluster").agg(F.count("*").alias("n"))
    total = sizes.agg(F.count("*").alias("k"), F.sum("n").alias("all"))
    x = _crossed(deps.where("source <> target"), part)
    flows = x.groupBy(F.col("cs").alias("cluster")).agg(F.sum(F.when(F.col("cs") == F.col("ct"), F.col("w")).otherwise(0)).alias("inside"), F.sum(F.when(F.col("cs") != F.col("ct"), F.col("w")).otherwise(0)).alias("outside"))
    each = sizes.join(flows, "cluster", "left").fillna(0, ["inside", "outside"]).join(F.broadcast(total))  # one row
    others = F.col("all") - F.col("n")
    cohesion = F.when(F.col("n") > 1, F.col("inside") / (F.col("n") * (F.col("n") - 1))).otherwise(F.lit(0.0))
    out = F.when(others > 0, F.col("outside") / (F.col("n") * others)).otherwise(F.lit(0.0))
    row = each.agg(F.avg(cohesion).alias("cohesion"), F.avg(out).alias("coupling"), F.max("k").alias("k"))
    zero = lambda c: F.when(F.col("k") > 1, F.col(c)).otherwise(F.lit(0.0)).alias(c)
    return row.select(zero("cohesion"), zero("coupling")).withColumn("sm", F.col("cohesion") - F.col("coupling"))


def modularity(edges: DataFrame, part: DataFrame, resolution: float = 1.0) -> DataFrame:
    """q, crossing, edges: Newman modularity of an undirected weighted graph (i, j, v), and its edges across clusters."""
    x = edges.join(part.select(F.col("n").alias("i"), F.col("cluster").alias("ci")), "i").join(part.select(F.col("n").alias("j"), F.col("cluster").alias("cj")), "j")
    ends = x.select(F.col("ci").alias("c"), "v", F.when(F.col("ci") == F.col("cj"), F.col("v")).otherwise(0.0).alias("inside")).union(x.select(F.col("cj").alias("c"), "v", F.lit(0.0)))
    each = ends.groupBy("c").agg(F.sum("v").alias("deg"), F.sum("inside").alias("inside"))
    m = x.agg(F.sum("v").alias("m"), F.count_if(F.col("ci") != F.col("cj")).alias("crossing"), F.count("*").alias("edges"))
    q = each.join(F.broadcast(m)).agg(F.sum(F.col("inside") / F.col("m") - resolution * F.pow(F.col("deg") / (2 * F.col("m")), F.lit(2.0))).alias("q"), F.max("crossing").alias("crossing"), F.max("edges").alias("edges"))  # one row
    return q


def cluster_sizes(part: DataFrame) -> DataFrame:
    """k, smallest, p25, median, p75, largest (percentiles cut to whole numbers), singletons."""
    sizes = part.groupBy("cluster").agg(F.count("*").alias("c"))
    q = F.percentile("c", F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75))))
    row = sizes.agg(F.count("*").alias("k"), F.min("c").alias("smallest"), F.max("c").alias("largest"), q.alias("q"), F.count_if(F.col("c") == 1).alias("singletons"))
    return row.select("k", "smallest", *(F.col("q")[i].cast("int").alias(x) for i, x in enumerate(("p25", "median", "p75"))), "largest", "singletons")


def partitions_from(rows: Iterator[tuple[str, str]]) -> dict[str, list[str]]:
    """Clusters of (node, cluster) rows by name, nodes in order."""
    out: dict[str, list[str]] = {}
    for n, c in rows:
        out.setdefault(c, []).append(n)
    return {c: sorted(ns) for c, ns in sorted(out.items())}


def k_report(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """k, gt_k, k_diff (signed), k_gap (its size), collapsed (two clusters or fewer where there are four or more): clusters found and true ones, over the nodes (n, cluster) that both have."""
    both = pred.select("n", F.col("cluster").alias("p")).join(truth.select("n", F.col("cluster").alias("t")), "n")
    row = both.agg(F.count_distinct("p").alias("k"), F.count_distinct("t").alias("gt_k")).withColumn("k_diff", F.col("k") - F.col("gt_k"))
    return row.withColumn("k_gap", F.abs("k_diff")).withColumn("collapsed", (F.col("k") <= 2) & (F.col("gt_k") >= 4))
