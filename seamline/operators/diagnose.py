"""Diagnosis of matrices and clusterings: degrees, densities, cluster links, baselines, sweeps of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from seamline.functions.text import leaf_package
from seamline.operators import ranges
from seamline.operators.components import connected_components
from seamline.operators.spectral import spectral  # noqa: F401


def degrees(sim: DataFrame) -> DataFrame:
    """n, weight, deg: sum and number of positive similarities of each node. The nodes that glue a graph together come first by weight."""
    ends = sim.where("v > 0").select(F.col("i").alias("n"), "v").union(sim.where("v > 0").select(F.col("j"), "v"))
    return ends.groupBy("n").agg(F.sum("v").alias("weight"), F.count("*").alias("deg"))


def density(sim: DataFrame, n: int) -> DataFrame:
    """edges (directed), density over n * (n - 1) cells off the diagonal, ratio over all n * n."""
    row = sim.agg((2 * F.count_if(F.col("v") > 0)).alias("edges"))
    return row.select("edges", (F.col("edges") / float(n * n - n)).alias("density"), (F.col("edges") / float(n * n)).alias("ratio"))


def cluster_links(sim: DataFrame, part: DataFrame) -> DataFrame:
    """a, b, mean, edges: mean similarity and positive pairs within (a = b) and between clusters. part: n, cluster."""
    x = sim.join(part.select(F.col("n").alias("i"), F.col("cluster").alias("ci")), "i").join(part.select(F.col("n").alias("j"), F.col("cluster").alias("cj")), "j")
    return x.groupBy(F.least("ci", "cj").alias("a"), F.greatest("ci", "cj").alias("b")).agg(F.avg("v").alias("mean"), F.count_if(F.col("v") > 0).alias("edges"))


def cap_sweep(sim: DataFrame, caps: list[float], quantile: float = 0.7) -> DataFrame:
    """cap, tau, edges, share: for each cap, the edge threshold min(quantile of positive values, cap) and what is above it. The grid is unrolled beside one row of counts a value."""
    tau = ranges.quantiles(sim.where("v > 0"), [quantile]).select(F.col("q")[0].alias("q"))
    grid = tau.select("q", F.explode(F.array(*(F.lit(float(c)) for c in caps))).alias("cap")).select("cap", F.least("q", "cap").alias("tau"))
    x = sim.join(F.broadcast(grid))  # one row for each cap
    return x.groupBy("cap", "tau").agg(F.count_if(F.col("v") > F.col("tau")).alias("edges"), F.avg((F.col("v") > F.col("tau")).cast("double")).alias("share"))


def adaptive_k(u: DataFrame) -> DataFrame:
    """One row k: ln 2 over the median uncertainty of all pairs, so that the median pair is damped to a half; null for a median of zero."""
    m = ranges.quantiles(u, [0.5]).select(F.col("q")[0].alias("m"))
    return m.select(F.when(F.col("m") > 0, F.log(F.lit(2.0)) / F.col("m")).alias("k"))


def leaf_smoothing(sim: DataFrame, names: DataFrame, eps: float) -> DataFrame:
    """v plus eps for pairs of one leaf package, which may be absent from sim. names: n (qualified)."""
    leaf = names.select("n", leaf_package(F.col("n")).alias("leaf")).where("leaf <> ''")
    near = leaf.select("leaf", F.col("n").alias("i")).join(leaf.select("leaf", F.col("n").alias("j")), "leaf").where("i < j").select("i", "j", F.lit(eps).alias("v"))
    return sim.select("i", "j", "v").union(near).groupBy("i", "j").agg(F.sum("v").alias("v"))


def reordered(sim: DataFrame, part: DataFrame) -> DataFrame:
    """n, cluster, pos, starts: the place of each node when clusters stand together, and whether a cluster starts there. Places come from cluster sizes, so each cluster is ranked on its own."""
    nodes = sim.select(F.col("i").alias("n")).union(sim.select("j")).distinct().join(part, "n")
    sizes = nodes.groupBy("cluster").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("cluster")) - F.col("c"))  # one row for each cluster
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy("n"))
    return nodes.withColumn("k", nth).join(sizes, "cluster").select("n", "cluster", (F.col("before") + F.col("k") - 1).alias("pos"), (F.col("k") == 1).alias("starts"))


def random_partition(nodes: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """n, cluster: each node in one of k clusters by its hash."""
    return nodes.select("n", F.pmod(F.xxhash64("n", F.lit(seed)), F.lit(k)).cast("int").alias("cluster"))


def monolith(nodes: DataFrame) -> DataFrame:
    return nodes.select("n", F.lit(0).alias("cluster"))


def cross_share(sim: DataFrame, labels: DataFrame, top: int) -> DataFrame:
    """top, crossing, share: of the `top` most similar pairs (ties by i, j), those of different labels (n, label)."""
    best = sim.orderBy(F.desc("v"), "i", "j").limit(top)
    x = best.join(labels.select(F.col("n").alias("i"), F.col("label").alias("a")), "i").join(labels.select(F.col("n").alias("j"), F.col("label").alias("b")), "j")
    return x.agg(F.count("*").alias("top"), F.count_if(F.col("a") != F.col("b")).alias("crossing"), F.avg((F.col("a") != F.col("b")).cast("double")).alias("share"))


def keyword_counts(pairs: DataFrame, keywords: list[str]) -> DataFrame:
    """keyword, n: how many names at the ends of pairs (i, j) contain each of the keywords, whatever the case."""
    ends = pairs.select(F.explode(F.array(F.lower("i"), F.lower("j"))).alias("n"))
    hit = F.filter(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.contains("n", k))
    return ends.select(F.explode(hit).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


def partition_stats(sim: DataFrame, part: DataFrame, least: float = 0.3) -> DataFrame:
    """One row: k, intra and inter (means over clusters, and over pairs of clusters, of their mean similarity), edges of `least` or more, their density, nodes without one.

    part: n, cluster, a row for each node. Absent pairs are 0; clusters of one node have no intra. Only sums and sizes are used.
    """
    sizes = part.groupBy("cluster").agg(F.count("*").alias("c"))
    x = sim.join(part.select(F.col("n").alias("i"), F.col("cluster").alias("ci")), "i").join(part.select(F.col("n").alias("j"), F.col("cluster").alias("cj")), "j")
    sums = x.groupBy(F.least("ci", "cj").alias("a"), F.greatest("ci", "cj").alias("b")).agg(F.sum("v").alias("s"))
    known = sums.join(sizes.select(F.col("cluster").alias("a"), F.col("c").alias("na")), "a").join(sizes.select(F.col("cluster").alias("b"), F.col("c").alias("nb")), "b")
    within = F.when((F.col("a") == F.col("b")) & (F.col("na") > 1), F.col("s") / (F.col("na") * (F.col("na") - 1) / 2))
    between = F.when(F.col("a") != F.col("b"), F.col("s") / (F.col("na") * F.col("nb")))
    means = known.agg(F.coalesce(F.sum(within), F.lit(0.0)).alias("within"), F.coalesce(F.sum(between), F.lit(0.0)).alias("between"))
    counts = sizes.agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.count_if(F.col("c") > 1).alias("many"))
    strong = sim.where(F.col("v") >= least)
    touched = strong.select("i").union(strong.select("j")).distinct().agg(F.count("*").alias("touched"))
    edges = strong.agg(F.count("*").alias("edges"))
    row = counts.join(F.broadcast(means)).join(F.broadcast(edges)).join(F.broadcast(touched))  # one row each
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    k, n = F.col("k"), F.col("n")
    return row.select("k", ratio(F.col("within"), F.col("many")).alias("intra"), ratio(F.col("between"), k * (k - 1) / 2).alias("inter"), "edges", ratio(2 * F.col("edges"), n * (n - 1)).alias("density"), (n - F.col("touched")).alias("isolated"))


def component_ratio(sim: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: intra, inter, ratio of similarities by the components of a session graph, whose nodes are tied where a session has both. sets: g, n; nodes: n (long); absent pairs are 0.

    Sessions tie their nodes by a star, so no pairs of a session are made. A node of no session is a component of its own. ratio is infinite without any inter.
    """
    sets = sets.join(nodes, "n", "left_semi")
    hub = sets.groupBy("g").agg(F.min("n").alias("h"))
    labels = connected_components(sets.join(hub, "g").select(F.col("n").alias("a"), F.col("h").alias("b")))
    part = nodes.distinct().join(labels.withColumnRenamed("node", "n"), "n", "left").select("n", F.coalesce("label", "n").alias("cluster"))
    x = sim.join(part.select(F.col("n").alias("i"), F.col("cluster").alias("ci")), "i").join(part.select(F.col("n").alias("j"), F.col("cluster").alias("cj")), "j")
    sums = x.agg(F.coalesce(F.sum(F.when(F.col("ci") == F.col("cj"), F.col("v"))), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.when(F.col("ci") != F.col("cj"), F.col("v"))), F.lit(0.0)).alias("b"))
    sizes = part.groupBy("cluster").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"), F.sum("c").alias("n"))
    mean = lambda s, k: F.when(k > 0, s / k)
    row = sums.join(F.broadcast(sizes)).select(mean(F.col("a"), F.col("same")).alias("intra"), mean(F.col("b"), F.col("n") * (F.col("n") - 1) / 2 - F.col("same")).alias("inter"))  # one row each
    return row.withColumn("ratio", F.when(F.col("inter") > 0, F.col("intra") / F.col("inter")).otherwise(F.lit(float("inf"))))


def radar(metrics: DataFrame, pairs: dict[str, bool]) -> DataFrame:
    """system, method, and each metric scaled within its system so that the best method has 1 and the worst 0 (0.5 where all are equal)."""
    w = Window.partitionBy("system")
    out = metrics
    for name, up in pairs.items():
        low, high = F.min(name).over(w), F.max(name).over(w)
        s = F.when(high - low < 1e-12, F.lit(0.5)).otherwise((F.col(name) - low) / (high - low))
        out = out.withColumn(f"{name}_score", s if up or up is None else F.when(high - low < 1e-12, F.lit(0.5)).otherwise(1 - (F.col(name) - low) / (high - low)))
    return out.select("system", "method", *(f"{n}_score" for n in pairs))


def diagnosis(rows: DataFrame) -> DataFrame:
    """rows (nonzero, ifn_gain, f1_gain; any may be null) with a verdict: first whether there was evidence at all, then what damping did to coupling (a gain is less of it) and accuracy."""
    less, more = F.col("ifn_gain") > 0, F.col("f1_gain") > 0
    worse, poorer = F.col("ifn_gain") < 0, F.col("f1_gain") < 0
    v = F.when(F.col("nonzero") < 0.05, "sparse evidence").when(less & poorer, "trade-off").when(less & more, "consistent gains").when(worse & poorer, "over-suppression")
    return rows.withColumn("diagnosis", v.otherwise("depends on the system"))


def cluster_report(part: DataFrame) -> DataFrame:
    """cluster, size, members in order."""
    return part.groupBy("cluster").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("n")).alias("members"))


def merge_spec(spec: str) -> dict[int, int]:
    """'1,3->1; 2->0' as {1: 1, 3: 1, 2: 0}."""
    out = {}
    for part in filter(None, map(str.strip, spec.split(";"))):
        left, arrow, right = part.partition("->")
        if not arrow or not left.strip() or not right.strip():
            raise ValueError(f"not a merge of labels: {part}")
        out |= {int(x): int(right) for x in left.split(",") if x.strip()}
    return out


def merged_labels(labels: DataFrame, spec: str) -> DataFrame:
    """labels (n, label) with labels merged as the specification says."""
    c = F.col("label")
    new = c
    for old, to in merge_spec(spec).items():
        new = F.when(c == old, F.lit(to)).otherwise(new)
    return labels.withColumn("label", new)
