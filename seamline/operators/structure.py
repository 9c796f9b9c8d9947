"""Graphs of code facts: hubs, denoised dependencies, name resolution, shared entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from seamline.functions.math import package_distance
from seamline.functions.text import package


def edge_counts(edges: DataFrame) -> DataFrame:
    """source, target, w: how often each edge stands there."""
    return edges.groupBy("source", "target").agg(F.count("*").alias("w"))


def indegree(edges: DataFrame) -> DataFrame:
    """n, deg: distinct sources of each target."""
    return edges.select("source", "target").distinct().groupBy(F.col("target").alias("n")).agg(F.count("*").alias("deg"))


def hub_weights(edges: DataFrame, n_nodes: int, share: float = 0.05, cut: int | None = None) -> DataFrame:
    """n, deg, idf, is_hub: the inverse-frequency weight ln((N+1)/(deg+1)) / ln(N+1), and whether the target is a hub: indegree at or above `cut`, or that of the node at the share's place."""
    deg = indegree(edges)
    k = max(1, -(-int(share * n_nodes * 1_000_000) // 1_000_000))
    # k is a share of the nodes, so the node at that place is found by counts of degrees.
    steps = deg.groupBy("deg").agg(F.count("*").alias("c")).withColumn("above", F.sum("c").over(Window.orderBy(F.desc("deg"))))
    level = steps.where(F.col("above") >= k).agg(F.max("deg").alias("level"))
    idf = F.log((F.lit(n_nodes) + 1.0) / (F.col("deg") + 1.0)) / F.log(F.lit(n_nodes + 1.0))
    hub = F.col("deg") >= F.coalesce("level", F.lit(1 << 40))
    if cut is not None:
        hub = hub | (F.col("deg") >= cut)
    return deg.join(F.broadcast(level)).select("n", "deg", idf.alias("idf"), hub.alias("is_hub"))  # one row


def denoised(edges: DataFrame, n_nodes: int, least: float = 0.12, drop_hubs: bool = True) -> DataFrame:
    """i, j, v: undirected dependencies weighted by the target's inverse frequency; weak ones and those into hubs go, the larger of two directions stays."""
    w = edges.select("source", "target").where("source <> target").distinct().join(hub_weights(edges, n_nodes).withColumnRenamed("n", "target"), "target")
    kept = w.where((F.col("idf") >= least) & (~F.col("is_hub") if drop_hubs else F.lit(True)))
    return kept.groupBy(F.least("source", "target").alias("i"), F.greatest("source", "target").alias("j")).agg(F.max("idf").alias("v"))


def call_mix(calls: DataFrame) -> DataFrame:
    """i, j, w: calls either way between two classes."""
    return calls.where("source <> target").groupBy(F.least("source", "target").alias("i"), F.greatest("source", "target").alias("j")).agg(F.count("*").alias("w"))


def weighted_calls(calls: DataFrame, n_classes: int, share: float = 0.2) -> DataFrame:
    """source, target, w: calls counted, doubled where they go both ways, and damped to a fifth into classes that a share of all classes call."""
    counted = edge_counts(calls.where("source <> target"))
    back = counted.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(True).alias("both"))
    callers = counted.groupBy("target").agg(F.count("*").alias("callers"))
    w = F.col("w") * F.when(F.col("both"), 2.0).otherwise(1.0) * F.when(F.col("callers") >= F.ceil(F.lit(share * n_classes)), 0.2).otherwise(1.0)
    return counted.join(back, ["source", "target"], "left").join(callers, "target").select("source", "target", w.alias("w"))


def longest_prefix(paths: DataFrame, classes: DataFrame) -> DataFrame:
    """path, fqcn: the longest dotted beginning of each distinct path ($ counts as a dot) that is a class (fqcn). Paths without one are absent."""
    p = paths.select("path").distinct().withColumn("parts", F.split(F.replace("path", F.lit("$"), F.lit(".")), r"\."))
    each = p.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.slice("parts", 1, k), "."))).alias("k", "fqcn"))
    return each.join(classes.select("fqcn").distinct(), "fqcn").groupBy("path").agg(F.max_by("fqcn", "k").alias("fqcn"))


def bridges(uses: DataFrame, cap: int = 2000) -> DataFrame:
    """i, j, n: nodes that share entities (n, entity), at most `cap` pairs for each entity, in order.

    A pair's place in that order follows from the places of its two nodes, so a popular entity is cut before its nodes meet: about `cap` pairs of it are made.
    """
    nth = F.row_number().over(Window.partitionBy("entity").orderBy("n"))
    near = uses.select("n", "entity").distinct().withColumn("k", nth).where(F.col("k") <= cap + 1).withColumn("m", F.count("*").over(Window.partitionBy("entity")))
    # Pairs of the nodes before the kth: m - 1 of the first, m - 2 of the second ...
    left = near.withColumn("before", (F.col("k") - 1) * (2 * F.col("m") - F.col("k")) / 2).where(F.col("before") < cap).select("entity", F.col("n").alias("i"), F.col("k").alias("a"), "before")
    right = near.select("entity", F.col("n").alias("j"), F.col("k").alias("b"))
    both = left.join(right, "entity").where((F.col("a") < F.col("b")) & (F.col("before") + F.col("b") - F.col("a") <= cap))
    return both.groupBy("i", "j").agg(F.count("*").alias("n"))


def boost(sim: DataFrame, adjacent: DataFrame, factor: float) -> DataFrame:
    """v times 1 + factor where the pair is adjacent (i, j) and v positive."""
    near = adjacent.select("i", "j").distinct().withColumn("_a", F.lit(True))
    return sim.join(near, ["i", "j"], "left").select("i", "j", F.when(F.col("_a") & (F.col("v") > 0), F.col("v") * (1 + factor)).otherwise(F.col("v")).alias("v"))


def mean_fill(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """n, v, origin: a node's own value (n, v), else its package's mean, else the mean of all. nodes: n, pkg."""
    own = nodes.join(values, "n", "left")
    per = own.where("v is not null").groupBy("pkg").agg(F.avg("v").alias("pv"))
    every = values.agg(F.avg("v").alias("gv"))
    origin = F.when(F.col("v").isNotNull(), "own").when(F.col("pv").isNotNull(), "package").otherwise("all")
    return own.join(per, "pkg", "left").join(F.broadcast(every)).select("n", F.coalesce("v", "pv", "gv").alias("v"), origin.alias("origin"))  # one row


def coverage(expected: DataFrame, found: DataFrame) -> DataFrame:
    """n, problem: nodes that are missing, extra, or found more than once."""
    missing = expected.join(found, "n", "left_anti").select("n", F.lit("missing").alias("problem"))
    extra = found.join(expected, "n", "left_anti").select("n", F.lit("extra").alias("problem")).distinct()
    twice = found.groupBy("n").count().where("count > 1").select("n", F.lit("duplicate").alias("problem"))
    return missing.distinct().union(extra).union(twice)


def conflict_rate(a: DataFrame, b: DataFrame) -> DataFrame:
    """either, differ, rate: edges (i, j) of two modalities that only one has, over those that any has."""
    x, y = a.select("i", "j").distinct().withColumn("x", F.lit(1)), b.select("i", "j").distinct().withColumn("y", F.lit(1))
    both = x.join(y, ["i", "j"], "full").agg(F.count("*").alias("either"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("differ"))
    return both.withColumn("rate", F.when(F.col("either") > 0, F.col("differ") / F.col("either")).otherwise(F.lit(0.0)))


def vector_fill(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """n, e, origin: a node's own vector (n, e), else the mean of its package's, else of all. nodes: n, pkg. Means are taken by component, so a package of any size is no row."""
    own = nodes.join(vectors, "n", "left").withColumn("has", F.col("e").isNotNull())
    parts = own.where("has").select("pkg", F.posexplode("e").alias("k", "x"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda y: y["x"])
    per = parts.groupBy("pkg", "k").agg(F.avg("x").alias("x")).groupBy("pkg").agg(whole.alias("mean"))
    every = vectors.where("e is not null").select(F.posexplode("e").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x")).agg(whole.alias("all"))
    origin = F.when(F.col("has"), "own").when(F.col("mean").isNotNull(), "package").otherwise("all")
    return own.join(per, "pkg", "left").join(F.broadcast(every)).select("n", F.coalesce("e", "mean", "all").alias("e"), origin.alias("origin"))  # one row


def package_similarity(names: DataFrame, block: int = 1024) -> DataFrame:
    """i, j, v for every pair of names (n): 1 in one package, else 1 / (1 + steps between the packages). Pairs meet in cells of a grid, by its keys."""
    n = names.distinct().count()
    blocks = max(1, -(-n // block))
    v = names.select("n").distinct().withColumn("own", F.pmod(F.xxhash64("n"), F.lit(blocks)))
    cells = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    left = cells.where("own = a").select("a", "b", F.col("n").alias("x"))
    right = cells.where("own = b").select("a", "b", F.col("n").alias("y"))
    pairs = left.join(right, ["a", "b"]).where("a < b or x < y")
    i, j = F.least("x", "y"), F.greatest("x", "y")
    p, q = package(i), package(j)
    return pairs.select(i.alias("i"), j.alias("j"), F.when(p == q, 1.0).otherwise(1 / (1 + package_distance(p, q))).alias("v"))


def dedup_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by `order` of each combination of the keys; null and empty keys are one."""
    norm = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*norm).orderBy(*order))).where("_k = 1").drop("_k")
