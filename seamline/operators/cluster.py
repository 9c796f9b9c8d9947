"""Clustering of weighted graphs over grids of resolutions: sweeps, small-cluster merging, the choice of a partition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seamline.operators.louvain import LIGHT, local as louvain, louvain as louvain_tables
from seamline.workspace import Workspace


def merge_small(part: dict, i: np.ndarray, j: np.ndarray, v: np.ndarray, least: int = 3) -> dict:
    """Nodes of clusters below `least` move to the neighbour cluster they are tied to most (then the smaller one), one at a time."""
    import heapq

    part, links = dict(part), {}
    for a, b, w in zip(i, j, v):
        links.setdefault(a, []).append((b, w))
        links.setdefault(b, []).append((a, w))
    members: dict = {}
    for n, c in part.items():
        members.setdefault(c, set()).add(n)
    heap = [(c, n) for c, own in members.items() if len(own) < least for n in own]
    heapq.heapify(heap)
    moved = set()  # each node moves once
    while heap:
        c, node = heapq.heappop(heap)
        if node in moved or part[node] != c or len(members[c]) >= least:
            continue
        moved.add(node)
        tie: dict = {}
        for b, w in links.get(node, ()):
            if part[b] != c:
                tie[part[b]] = tie.get(part[b], 0.0) + w
        if tie:
            to = min(tie, key=lambda x: (-tie[x], x))
            part[node] = to
            members[c].discard(node)
            members[to].add(node)
    return part


def _merge_rest(items: list, near: list, size: dict, least: int) -> dict:
    """New cluster of the nodes that move. items: (cluster, node) in the order of merge_small; near: (node, neighbour, the neighbour's cluster, weight); size: of the clusters that occur."""
    part, links = {n: c for c, n in items}, {}
    for n, b, c, w in near:
        part.setdefault(b, c)
        links.setdefault(n, []).append((b, w))
    moved = {}
    for c, n in sorted(items):
        if size[c] >= least:
            continue
        tie: dict = {}
        for b, w in links.get(n, ()):
            if part[b] != c:
                tie[part[b]] = tie.get(part[b], 0.0) + w
        if tie:
            to = min(tie, key=lambda x: (-tie[x], x))
            part[n] = moved[n] = to
            size[c] -= 1
            size[to] += 1
    return moved


def merge_tables(parts: DataFrame, links: DataFrame, least: int = 3, light: int = LIGHT) -> DataFrame:
    """p, n, cluster: what merge_small makes of each partition (p, n, cluster) of a graph (p, i, j, v), over tables.

    Nodes of small clusters decide in the order of their clusters and names. One decides once no earlier undecided node is in, or has a neighbour in, a cluster with undecided nodes that it is in or next to itself:
    then nothing that comes before it in the order can change what it sees, and it changes nothing that they see. All such nodes decide in one round. Once those that are left have `light` links, one task ends the work.
    """
    work = Workspace(parts.sparkSession, "merge")
    kind = parts.schema["n"].dataType.simpleString()
    both = links.where("v > 0 and i <> j").select("p", F.col("i").alias("n"), F.col("j").alias("b"), "v").union(links.where("v > 0 and i <> j").select("p", F.col("j").alias("n"), F.col("i").alias("b"), "v"))
    sized = parts.groupBy("p", "cluster").agg(F.count("*").alias("size"))
    small = parts.join(sized.where(F.col("size") < least), ["p", "cluster"])
    items = work.keep(small.select("p", "n", F.col("cluster").alias("c")), "items0")
    ties = work.keep(both.join(items.select("p", "n"), ["p", "n"]), "ties")  # the links of these nodes alone
    state, step = work.keep(parts.select("p", "n", F.col("cluster").alias("c")), "state0"), 0
    while left := items.count():
        sizes = state.groupBy("p", "c").agg(F.count("*").alias("size"))
        near = items.join(ties, ["p", "n"]).join(state.select("p", F.col("n").alias("b"), F.col("c").alias("d")), ["p", "b"])
        near = work.keep(near.select("p", "n", "c", "b", "d", "v"), f"near{step}")
        if near.count() + left <= light:
            rows = items.select("p", "n", "c", F.lit(None).cast(kind).alias("b"), F.lit(None).cast(kind).alias("d"), F.lit(0.0).alias("v")).unionByName(near)
            seen = rows.select("p", "c").union(near.select("p", F.col("d").alias("c"))).distinct().join(sizes, ["p", "c"])
            found = rows.withColumn("size", F.lit(0).cast("long")).unionByName(seen.select("p", F.lit(None).cast(kind).alias("n"), "c", F.lit(None).cast(kind).alias("b"), F.lit(None).cast(kind).alias("d"), F.lit(0.0).alias("v"), "size"))

            def end(pdf: pd.DataFrame) -> pd.DataFrame:
                sizes, own, far = pdf[pdf["n"].isna()], pdf[pdf["n"].notna() & pdf["b"].isna()], pdf[pdf["b"].notna()]
                far = far.sort_values(["n", "b"])
                plain = lambda x, *cs: list(zip(*(x[c].astype(typed).tolist() for c in cs)))
                moved = _merge_rest(plain(own, "c", "n"), [(n, b, d, w) for (n, b, d), w in zip(plain(far, "n", "b", "d"), far["v"])], dict(zip(sizes["c"].astype(typed).tolist(), sizes["size"].tolist())), least)
                return pd.DataFrame({"p": pdf["p"].iloc[0], "n": list(moved), "to": list(moved.values())})

            typed = "int64" if kind in ("bigint", "int", "smallint", "tinyint") else object
            decided, items = work.keep(found.groupBy("p").applyInPandas(end, f"p int, n {kind}, to {kind}"), f"decided{step}"), items.where("false")
        else:
            key = F.struct("c", "n").alias("key")
            touch = near.select("p", F.col("d").alias("at"), key, F.lit(0).alias("own")).union(items.select("p", F.col("c").alias("at"), key, F.lit(1).alias("own"))).distinct()
            first = touch.groupBy("p", "at").agg(F.min("key").alias("first"), F.max("own").alias("own")).where("own = 1").drop("own")  # clusters with undecided nodes
            waits = touch.drop("own").join(first, ["p", "at"]).where(F.col("first") < F.col("key")).select("p", F.col("key.n").alias("n")).distinct()
            ready = work.keep(items.join(waits, ["p", "n"], "left_anti"), f"ready{step}")
            tie = near.join(ready.select("p", "n"), ["p", "n"], "left_semi").where("d <> c").groupBy("p", "n", "c", "d").agg(F.sum("v").alias("w"))
            best = tie.groupBy("p", "n", "c").agg(F.min(F.struct((-F.col("w")).alias("w"), "d"))["d"].alias("to"))
            decided = work.keep(best.join(sizes.where(F.col("size") < least).select("p", "c"), ["p", "c"], "left_semi").select("p", "n", "to"), f"decided{step}")
            items = work.keep(items.join(ready.select("p", "n"), ["p", "n"], "left_anti"), f"items{step + 1}")
        step += 1
        state = work.keep(state.join(decided, ["p", "n"], "left").select("p", "n", F.coalesce("to", "c").alias("c")), f"state{step}")
        work.drop(f"near{step - 1}", f"state{step - 1}")
    return state.select("p", "n", F.col("c").alias("cluster"))


def swept(edges: DataFrame, resolutions: list[float], least: int = 0, by: tuple[str, ...] = (), light: int = LIGHT) -> DataFrame:
    """by, resolution, n, cluster: Louvain of each graph (by, i, j, v) at each resolution, then merging of clusters below `least`.

    Graphs of at most `light` pairs of nodes take a task for each resolution. Larger ones go through tables, all points of the grid at once.
    """
    kind = edges.schema["i"].dataType.simpleString()
    points = "".join(f"{c} {edges.schema[c].dataType.simpleString()}, " for c in by)
    names = [*by, "resolution"]
    work = Workspace(edges.sparkSession, "swept")
    graph = work.keep(edges.where("v > 0").groupBy(*by, "i", "j").agg(F.sum("v").alias("v")), "graph")
    large = graph.groupBy(*by).agg(F.count("*").alias("pairs")).where(F.col("pairs") > light).drop("pairs").collect()  # graphs of the grid
    grid = F.explode(F.array(*(F.lit(float(r)) for r in resolutions)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        i, j, v = (pdf[c].to_numpy() for c in ("i", "j", "v"))
        part = louvain(i, j, v, float(pdf["resolution"].iloc[0]))
        if least:
            part = merge_small(part, i, j, v, least)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "resolution": pdf["resolution"].iloc[0], "n": list(part), "cluster": list(part.values())})

    if not large:
        return graph.withColumn("resolution", grid).groupBy(*names).applyInPandas(run, f"{points}resolution double, n {kind}, cluster {kind}")
    each = [(p, *row, float(r)) for p, (row, r) in enumerate((row, r) for row in large for r in resolutions)]
    of = F.broadcast(edges.sparkSession.createDataFrame(each, f"p int, {points}resolution double"))
    wide = work.keep(graph.join(of, list(by)) if by else graph.crossJoin(of), "wide")  # one row for each pair and resolution
    found = louvain_tables(wide.select("p", "i", "j", "v"), {x[0]: x[-1] for x in each}, light)
    if least:
        found = merge_tables(work.keep(found, "found"), wide.select("p", "i", "j", "v"), least, light)
    found = found.join(of, "p").select(*names, "n", "cluster")
    few = graph.join(of.select(*by).distinct(), list(by), "left_anti") if by else graph.where("false")
    return few.withColumn("resolution", grid).groupBy(*names).applyInPandas(run, f"{points}resolution double, n {kind}, cluster {kind}").unionByName(found)


def resolutions(low: float = 0.1, high: float = 8.0, step: float = 0.05) -> list[float]:
    """low, low + step ... below high."""
    return [round(float(x), 10) for x in np.arange(low, high, step)]


def scored(edges: DataFrame, parts: DataFrame, by: tuple[str, ...] = (), penalty: float = 0.05) -> DataFrame:
    """by, resolution, k, q, ratio, score of each partition (by, resolution, n, cluster) of the graph (by, i, j, v): clusters, modularity, share of crossing edges, and q less `penalty` of it."""
    point = [*by, "resolution"]
    e = edges.where("v > 0").groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))
    side = lambda n, c: parts.select(*point, F.col("n").alias(n), F.col("cluster").alias(c))
    x = side("i", "ci").join(e, [*by, "i"]).join(side("j", "cj"), [*point, "j"])
    ends = x.select(*point, F.col("ci").alias("c"), "v", F.when(F.col("ci") == F.col("cj"), F.col("v")).otherwise(0.0).alias("inside")).union(x.select(*point, F.col("cj"), "v", F.lit(0.0)))
    m = x.groupBy(*point).agg(F.sum("v").alias("m"), F.avg((F.col("ci") != F.col("cj")).cast("double")).alias("ratio"))
    gain = F.col("inside") / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), F.lit(2.0))
    q = ends.groupBy(*point, "c").agg(F.sum("v").alias("deg"), F.sum("inside").alias("inside")).join(m, point).groupBy(*point).agg(F.sum(gain).alias("q"), F.max("ratio").alias("ratio"))
    k = parts.groupBy(*point).agg(F.countDistinct("cluster").alias("k"))
    return q.join(k, point).withColumn("score", F.col("q") - penalty * F.col("ratio")).select(*point, "k", "q", "ratio", "score")


def best_resolution(edges: DataFrame, parts: DataFrame, k_low: int, k_high: int, penalty: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """by, resolution, k, q, ratio, score, status: each point's modularity and share of crossing edges; the best of those with k in range is chosen, or none is. A positive modularity comes first."""
    from pyspark.sql.window import Window

    good = F.col("k").between(k_low, k_high)
    nth = F.row_number().over(Window.orderBy(good.desc(), (F.col("q") > 0).desc(), F.desc(F.round("score", 9)), *by, "resolution"))  # one row for each grid point
    return scored(edges, parts, by, penalty).select(*by, "resolution", "k", "q", "ratio", "score", F.when((nth == 1) & good, "chosen").when(good, "valid").otherwise("no solution").alias("status"))


def chosen_partition(edges: DataFrame, k_low: int, k_high: int, grid: list[float], least: int = 0) -> DataFrame:
    """n, cluster, resolution: the partition of the best point of a sweep, merged; no rows if there is none, or if merging takes its number of clusters out of the range."""
    work = Workspace(edges.sparkSession, "sweep")
    graph = work.keep(edges, "graph")
    parts = work.keep(swept(graph, grid), "parts")
    best = work.keep(best_resolution(graph, parts, k_low, k_high).where("status = 'chosen'").select("resolution"), "best")  # one row
    point = [r["resolution"] for r in best.collect()]
    if not point:
        return parts.where("false").select("n", "cluster", "resolution")
    final = work.keep(swept(graph, point, least), "final")
    inside = final.agg(F.count_distinct("cluster").between(k_low, k_high).alias("ok"))  # one row
    return final.join(F.broadcast(inside)).where("ok").select("n", "cluster", "resolution")


def damping_points(sim: DataFrame, u: DataFrame, n: int, modes: dict[str, list[float]], floors: list[float]) -> DataFrame:
    """mode, param, floor, i, j, v: the graph of every point of a grid: similarities damped by each mode with each of its parameters, without edges below the floor."""
    from seamline.operators import fusion

    out = None
    for mode, params in modes.items():
        for p in params:
            named = {"exp": {"k": p}, "gate": {"power": p}, "sigmoid": {"alpha": p}}[mode]
            one = fusion.damped(sim, u, n, mode, **named).select(F.lit(mode).alias("mode"), F.lit(float(p)).alias("param"), "i", "j", "v")
            out = one if out is None else out.union(one)
    floor = F.explode(F.array(*(F.lit(float(f)) for f in floors)))
    return out.withColumn("floor", floor).where("v >= floor and v > 0").select("mode", "param", "floor", "i", "j", "v")
