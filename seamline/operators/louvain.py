"""Louvain clustering of graphs of any size: nodes move at the same time, over tables of links, level by level.

Many graphs or resolutions advance together, each a point p of a grid. In a round half the nodes, another half each time, look at the clusters of their neighbours as they were at its start and move to the best one;
two clusters of one node each join only towards the smaller name, so neighbours don't change places for ever. A round that makes the modularity worse is not kept. At the end of a level clusters become nodes.
Between rounds only a few numbers for each point come to the driver. A point whose graph has few links left is ended by one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seamline.operators.components import connected_components
from seamline.operators.skew import HOT_SHARE, join_counted
from seamline.workspace import Workspace

#: Links that one task may well hold and go through.
LIGHT = 1 << 15


def local(i: np.ndarray, j: np.ndarray, v: np.ndarray, resolution: float = 1.0, two_m: float | None = None) -> dict:
    """Node -> cluster (the least node of it), node after node. Nodes are visited in order, ties go to the smaller cluster, so reruns agree. A link of a node with itself is weight inside. two_m: the weight of all ends where the links are a part of a graph that no link joins with the rest."""
    names, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    links: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in zip(at[: len(i)].tolist(), at[len(i) :].tolist(), v.tolist()):
        links[a][b] = links[a].get(b, 0.0) + w
        links[b][a] = links[b].get(a, 0.0) + w if a != b else links[b].get(a, 0.0)
    group = list(range(len(names)))
    inner = [0.0] * len(names)
    while True:
        com, moved = _one_level(links, inner, resolution, two_m)
        if not moved:
            break
        ids = {c: k for k, c in enumerate(sorted(set(com)))}
        com = [ids[c] for c in com]
        group = [com[g] for g in group]
        new: list[dict[int, float]] = [{} for _ in ids]
        new_inner = [0.0] * len(ids)
        for a, row in enumerate(links):
            new_inner[com[a]] += inner[a]
            for b, w in row.items():
                if com[a] == com[b]:
                    new_inner[com[a]] += w
                else:
                    new[com[a]][com[b]] = new[com[a]].get(com[b], 0.0) + w
        links, inner = new, new_inner
    first: dict[int, int] = {}
    for k, g in enumerate(group):
        first.setdefault(g, k)
    return {names[k]: names[first[g]] for k, g in enumerate(group)}


def _one_level(links: list[dict[int, float]], inner: list[float], resolution: float, two_m: float | None = None) -> tuple[list[int], bool]:
    deg = [sum(row.values()) + inner[a] for a, row in enumerate(links)]
    two_m = two_m or sum(deg) or 1.0
    com, total, any_ = list(range(len(links))), deg[:], False
    for _ in range(100):
        moved = False
        for a, row in enumerate(links):
            own = com[a]
            total[own] -= deg[a]
            to: dict[int, float] = {own: 0.0}
            for b, w in row.items():
                if b != a:
                    to[com[b]] = to.get(com[b], 0.0) + w
            gain = {c: w - resolution * total[c] * deg[a] / two_m for c, w in to.items()}
            best = min(gain, key=lambda c: (-gain[c], c))
            if gain[best] <= gain[own] + 1e-12:
                best = own
            total[best] += deg[a]
            if best != own:
                com[a], moved, any_ = best, True, True
        if not moved:
            break
    return com, any_


def _only(points: set[int]):
    return F.col("p").isin(sorted(points)) if points else F.lit(False)


class _Level:
    """Rounds of moves on one level. links: p, src, dst, v, deg (of src), both directions. nodes: p, n, c (its cluster), deg, inner (weight inside), links (rows of links with it)."""

    def __init__(self, work: Workspace, name: str, links: DataFrame, nodes: DataFrame, rates: DataFrame, met):
        self.work, self.name, self.links, self.rates, self.met = work, name, links, rates, met
        self.states = [work.keep(self.placed(nodes), f"{name}-state0")]

    def placed(self, nodes: DataFrame) -> DataFrame:
        """nodes with the weight and the number of nodes of their clusters. A large cluster's rows are split by the adaptive join."""
        clusters = nodes.groupBy("p", "c").agg(F.sum("deg").alias("tot"), F.count("*").alias("size"))
        return nodes.join(clusters, ["p", "c"]).select("p", "n", "c", "deg", "inner", "links", "tot", "size")

    def round(self, k: int) -> dict[int, tuple[int, float]]:
        """State k + 1 from state k. Of each point: nodes that move, and the modularity before they do."""
        s = self.states[k]
        near = self.met(self.links, s.select("p", F.col("n").alias("dst"), "c", "tot", "size", "links"), "dst")
        none = F.lit(0)
        seen = near.select("p", "src", "c", "v", "deg", "tot", "size", none.alias("own"), F.lit(0.0).alias("inner"), none.cast("long").alias("links"))
        mine = s.select("p", F.col("n").alias("src"), "c", F.lit(0.0).alias("v"), "deg", "tot", "size", F.lit(1).alias("own"), "inner", "links")
        most = lambda *cs: [F.max(c).alias(c) for c in cs]  # noqa: E731  the same in all rows that have it
        to = seen.unionByName(mine).groupBy("p", "src", "c").agg(F.sum("v").alias("w"), *most("deg", "tot", "size", "own", "inner", "links"))
        to = to.join(F.broadcast(self.rates), "p").withColumn("gain", F.round(F.col("w") - F.col("rate") * F.col("deg") * (F.col("tot") - F.col("own") * F.col("deg")), 12))
        own = lambda c: F.max(F.when(F.col("own") == 1, F.col(c))).alias(f"own_{c}")
        best = F.min(F.struct((-F.col("gain")).alias("loss"), (1 - F.col("own")).alias("away"), "c", "size")).alias("best")
        chosen = to.groupBy("p", F.col("src").alias("n")).agg(best, own("c"), own("gain"), own("w"), own("tot"), own("size"), *most("deg", "inner", "links"))
        awake = F.pmod(F.xxhash64("n", F.lit(k // 2)), F.lit(2)) == k % 2
        trade = (F.col("best.size") == 1) & (F.col("own_size") == 1) & (F.col("best.c") > F.col("own_c"))
        moves = awake & (F.col("best.c") != F.col("own_c")) & (-F.col("best.loss") > F.col("own_gain") + 1e-12) & ~trade
        chosen = chosen.select("p", "n", F.when(moves, F.col("best.c")).otherwise(F.col("own_c")).alias("c"), "deg", "inner", "links", moves.cast("long").alias("moved"), (F.col("own_w") + F.col("inner")).alias("inside"), (F.col("deg") * F.col("own_tot")).alias("square"))
        chosen = self.work.keep(chosen, f"{self.name}-chosen{k}")
        stats = chosen.groupBy("p").agg(F.sum("moved").alias("moved"), F.sum("inside").alias("inside"), F.sum("square").alias("square")).join(F.broadcast(self.rates), "p")
        found = {r["p"]: (r["moved"], r["inside"] / r["m2"] - r["rate"] * r["square"] / r["m2"]) for r in stats.collect()}  # one row for each point
        self.states.append(self.work.keep(self.placed(chosen), f"{self.name}-state{k + 1}"))
        self.work.drop(f"{self.name}-chosen{k}")
        return found

    def run(self, few: dict[int, int], patience: int, most: int) -> tuple[DataFrame, set[int]]:
        """p, n, c, inner, links of each point's best round, and the points in which nothing has moved. A point rests once no more than `few` of its nodes move."""
        best: dict[int, tuple[float, int]] = {}
        still, waits, calm = set(), {}, {}
        for k in range(most):
            for p, (moved, q) in self.round(k).items():
                if p in still:
                    continue
                waits[p] = 0 if p not in best or q > best[p][0] else waits[p] + 1
                if waits[p] == 0:
                    best[p] = q, k
                calm[p] = 0 if moved > few[p] else calm.get(p, 0) + 1
                if calm[p] >= 2 and k % 2 or waits[p] >= patience:
                    still.add(p)
            if len(still) == len(best):
                break
        out = None
        for k in {k for _, k in best.values()}:
            one = self.states[k].where(_only({p for p, (_, at) in best.items() if at == k}))
            out = one if out is None else out.unionByName(one)
        return out, {p for p, (_, k) in best.items() if k == 0}


def _parted(work: Workspace, pairs: DataFrame, n_links: int, light: int) -> DataFrame:
    """pairs (p, src, dst, v) with `part`: connected components of at most `light` links share a number with others, about `light` links each; links of larger components get null.

    No gain depends on other components but by the weight of all links, so parts can be clustered one by one. Nodes are told by hashes; two with one hash are taken for one, which makes a part larger and changes nothing else.
    """
    one = lambda c: F.xxhash64("p", c)
    found = connected_components(pairs.select(one("src").alias("a"), one("dst").alias("b"))).withColumnRenamed("node", "_a")
    named = pairs.withColumn("_a", one("src")).join(found, "_a", "left").select("p", "src", "dst", "v", F.coalesce("label", "_a").alias("label"))
    named = work.keep(named, "labelled")
    huge = named.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > light).select("label", F.lit(True).alias("huge"))  # one row for each `light` links at most
    parts = F.pmod(F.xxhash64("label", F.lit(7)), F.lit(-(-n_links // max(1, light)))).cast("int")
    return work.keep(named.join(F.broadcast(huge), "label", "left").select("p", "src", "dst", "v", F.when(F.col("huge").isNull(), parts).alias("part")), "parted")


def louvain(graphs: DataFrame, resolutions: dict[int, float], light: int = LIGHT, calm: float = 0.03, patience: int = 3, rounds: int = 30, polish: int = 8) -> DataFrame:
    """p, n, cluster (its least node): Louvain of each graph (p, i, j, v), whose resolution is that of p. Weights are above zero; a pair may stand several times, either way round.

    A graph of at most `light` links is ended by one task, and so are connected components of a larger one, some `light` links a task. A level ends for a point when two rounds, one for each half of the nodes, each move a share of `calm` or less, or when `patience` rounds gain nothing.
    In the end up to `polish` rounds move single nodes between the clusters found. Nodes with many links and clusters with many nodes
    are hot keys of joins and are broadcast, fewer than a thousand of them. Reruns agree but for sums of doubles in their last digits. No links: no rows.
    """
    spark = graphs.sparkSession
    work = Workspace(spark, "louvain")
    kind = graphs.schema["i"].dataType.simpleString()
    once = graphs.where("v > 0").select("p", F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), "v").groupBy("p", "src", "dst").agg(F.sum("v").alias("v"))
    pairs = work.keep(once, "pairs")
    labels, done, level, first, wide = None, None, 0, None, {}

    def end(part: DataFrame) -> pd.DataFrame:
        part = part.sort_values(["src", "dst"])
        p = int(part["p"].iloc[0])
        found = local(part["src"].to_numpy(), part["dst"].to_numpy(), part["v"].to_numpy(), resolutions[p], ends[p])
        return pd.DataFrame({"p": p, "n": list(found), "cluster": list(found.values())})

    def add(rows: DataFrame) -> None:
        """Final clusters of some points: p, n (of this level), cluster."""
        nonlocal done
        if labels is not None:
            counted = rows.join(labels.groupBy("p", "n").agg(F.count("*").alias("rows")), ["p", "n"])
            rows = join_counted(labels.join(F.broadcast(rows.select("p").distinct()), "p"), work.keep(counted, f"final{level}"), ["p", "n"], labels.count(), "rows").select("p", F.col("node").alias("n"), "cluster")
        done = rows if done is None else done.unionByName(rows)

    def named(found: DataFrame, n_nodes: int) -> DataFrame:
        """Clusters are named by their least node."""
        names = found.groupBy("p", "c").agg(F.min("n").alias("cluster"), F.count("*").alias("rows"))
        return join_counted(found.select("p", "n", "c", "inner", "links"), names, ["p", "c"], n_nodes, "rows").select("p", "n", "cluster", "inner", "links")

    stats = pairs.groupBy("p").agg(F.count("*").alias("n"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("v")).otherwise(2 * F.col("v"))).alias("ends")).collect()  # one row for each point
    counts, ends, apart = {r["p"]: r["n"] for r in stats}, {r["p"]: r["ends"] for r in stats}, None
    large = {p for p, n in counts.items() if n > light}
    if large:
        parted = _parted(work, pairs.where(_only(large)), sum(counts[p] for p in large), light)
        alone = parted.where("part is not null")
        apart = work.keep(alone.groupBy("p", "part").applyInPandas(end, f"p int, n {kind}, cluster {kind}"), "apart")
        pairs = pairs.where(~_only(large)).unionByName(parted.where("part is null").drop("part"))
        counts = {r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.count("*").alias("n")).collect()}
    while counts:
        few = {p for p, n in counts.items() if n <= light}
        if few:
            add(work.keep(pairs.where(_only(few)).groupBy("p").applyInPandas(end, f"p int, n {kind}, cluster {kind}"), f"ended{level}"))
        many = set(counts) - few
        if not many:
            break
        here = pairs.where(_only(many))
        both = here.where("src <> dst").select("p", "src", "dst", "v").union(here.where("src <> dst").select("p", F.col("dst").alias("src"), F.col("src").alias("dst"), "v"))
        inside = here.where("src = dst").select("p", F.col("src").alias("n"), F.col("v").alias("inner"))
        sides = both.select("p", F.col("src").alias("n"), "v", F.lit(0.0).alias("inner"), F.lit(1).alias("links")).unionByName(inside.select("p", "n", F.lit(0.0).alias("v"), "inner", F.lit(0).alias("links")))
        nodes = sides.groupBy("p", "n").agg((F.sum("v") + F.sum("inner")).alias("deg"), F.sum("inner").alias("inner"), F.sum("links").alias("links"))
        nodes = work.keep(nodes, f"nodes{level}")
        both, n_links = work.keep(both, f"both{level}"), 2 * sum(counts[p] for p in many)
        sums = nodes.groupBy("p").agg(F.max("links").alias("links"), F.count("*").alias("nodes")).collect()  # one row for each point
        n_nodes, hubs = sum(r["nodes"] for r in sums), max(r["links"] for r in sums) * HOT_SHARE > n_links

        def met(rows: DataFrame, of: DataFrame, end: str, n_links: int = n_links, hubs: bool = hubs) -> DataFrame:
            """Rows of links with what is known of the nodes at one end; without hubs no key is hot."""
            return join_counted(rows, of, ["p", end], n_links, "links") if hubs else rows.join(of.drop("links"), ["p", end])

        links = work.keep(met(both, nodes.select("p", F.col("n").alias("src"), "deg", "links"), "src"), f"links{level}")
        rates = spark.createDataFrame([(p, resolutions[p] / ends[p], ends[p]) for p in sorted(many)], "p int, rate double, m2 double")
        wide = wide or {r["p"]: r["nodes"] for r in sums}
        first = first or (links, nodes, rates, met, n_nodes)
        found, same = _Level(work, f"level{level}", links, nodes.withColumn("c", F.col("n")), rates, met).run({r["p"]: int(calm * r["nodes"]) for r in sums}, patience, rounds)
        to = work.keep(named(found, n_nodes), f"to{level}")
        if same:
            add(to.where(_only(same)).select("p", "n", "cluster"))
        if labels is None:
            labels = to.select("p", F.col("n").alias("node"), F.col("cluster").alias("n"))
        else:
            sized = to.join(labels.groupBy("p", "n").agg(F.count("*").alias("rows")), ["p", "n"])
            labels = work.keep(join_counted(labels, work.keep(sized.select("p", "n", "cluster", "rows"), f"sized{level}"), ["p", "n"], labels.count(), "rows").select("p", "node", F.col("cluster").alias("n")), f"labels{level}")
        ahead = to.where(~_only(same))
        a = met(both.where(~_only(same)), ahead.select("p", F.col("n").alias("dst"), F.col("cluster").alias("b"), "links"), "dst")
        b = met(work.keep(a.select("p", "src", "b", "v"), f"half{level}"), ahead.select("p", F.col("n").alias("src"), F.col("cluster").alias("a"), "links"), "src")
        # Each link stands twice here: between clusters one of the two is taken, inside a cluster both are its weight.
        merged = b.where("a <= b").select("p", F.col("a").alias("src"), F.col("b").alias("dst"), "v").unionByName(ahead.where("inner > 0").select("p", F.col("cluster").alias("src"), F.col("cluster").alias("dst"), F.col("inner").alias("v")))
        pairs = work.keep(merged.groupBy("p", "src", "dst").agg(F.sum("v").alias("v")), f"pairs{level + 1}")
        level += 1
        counts = {r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.count("*").alias("n")).collect()}
    if done is None and apart is not None:
        return apart
    if done is None:
        return graphs.select("p", F.col("i").alias("n"), F.col("i").alias("cluster")).where("false")
    if first is None or not polish:
        return done if apart is None else done.unionByName(apart)
    links, nodes, rates, met, n_nodes = first
    coarse = work.keep(done, "coarse")
    start = nodes.join(coarse.withColumnRenamed("cluster", "c"), ["p", "n"])
    better, _ = _Level(work, "polish", links, start, rates, met).run({p: int(calm * n / 10) for p, n in wide.items()}, patience, polish)
    out = coarse.where(~_only(set(wide))).unionByName(named(better, n_nodes).select("p", "n", "cluster"))
    return out if apart is None else out.unionByName(apart)
