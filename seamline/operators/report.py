"""Tables of results: improvements, means over systems, gates, best rows, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from seamline.functions.math import improvement


def mean_rows(metrics: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Each group's rows, mean and sample deviation (0 for one row); a last row ALL over everything."""
    aggs = [f for v in values for f in (F.avg(v).alias(f"{v}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_sd"))]
    rolled = metrics.rollup(by).agg(F.grouping(by).alias("_all"), F.count("*").alias("n"), *aggs)
    return rolled.withColumn(by, F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col(by))).drop("_all")


def improvements(metrics: DataFrame, key: str, method: str, base: str, new: str, values: dict[str, bool]) -> DataFrame:
    """key, metric, base, new, percent for each value (True: higher is better), comparing two methods; small_base flags a base near zero, whose percent says little."""
    narrow = None
    for v, up in values.items():
        part = metrics.select(key, method, F.lit(v).alias("metric"), F.col(v).cast("double").alias("x"), F.lit(up).alias("up"))
        narrow = part if narrow is None else narrow.union(part)
    wide = narrow.groupBy(key, "metric", "up").agg(F.max(F.when(F.col(method) == base, F.col("x"))).alias("base"), F.max(F.when(F.col(method) == new, F.col("x"))).alias("new"))
    percent = F.when(F.col("up"), improvement(F.col("new"), F.col("base"), True)).otherwise(improvement(F.col("new"), F.col("base"), False))
    return wide.select(key, "metric", "base", "new", percent.alias("percent"), (F.abs("base") < 0.05).alias("small_base"))


def gate(stats: DataFrame, least_ratio: float = 1.2, least_edges: int = 10, least_density: float = 0.001) -> DataFrame:
    """stats (edges, density, ratio) with status PASS or FAIL and the reasons."""
    tests = {"edges": F.col("edges") < least_edges, "density": F.col("density") < least_density, "ratio": F.coalesce(F.col("ratio") < least_ratio, F.lit(True))}
    reasons = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in tests.items())))
    return stats.withColumn("reasons", F.array_join(reasons, ",")).withColumn("status", F.when(F.col("reasons") == "", "PASS").otherwise("FAIL"))


def best(rows: DataFrame, by: list[str], order: list[str], ties: str) -> DataFrame:
    """The row of each group with the largest `order` values, then the least `ties`."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order), ties))
    return rows.withColumn("_k", nth).where("_k = 1").drop("_k")


def to_markdown(df: DataFrame, rows: int = 1000) -> str:
    """A small result as a Markdown table; more than `rows` rows are refused rather than cut."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows: write the table instead")
    line = lambda xs: "| " + " | ".join("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *(line(r) for r in got)])


#: The least number of cells off the diagonal, as a share of all and as a number, of systems by size.
LEAST_CELLS = {"acmeair": (0.02, 80), "jpetstore": (0.02, 80), "plants": (0.08, 50)}


def least_cells(system: str, n: int, default: int = 200) -> int:
    """How many cells off the diagonal a matrix of n nodes must have."""
    share, floor = LEAST_CELLS.get(system, (0.0, default))
    return max(floor, int(share * n * (n - 1)))


def temporal_gate(stats: DataFrame, least: int, least_density: float = 1e-3, least_ratio: float = 1.0, p50: float = 3, p90: float = 4) -> DataFrame:
    """stats (offdiag, density, ratio, p50, p90) with status PASS or FAIL and the reasons: the five thresholds of the temporal gate. A ratio that is infinite passes, a null one fails."""
    ratio = F.col("ratio")
    tests = {
        "offdiag": F.col("offdiag") < least, "density": F.col("density") < least_density, "ratio": F.coalesce((ratio != float("inf")) & (ratio < least_ratio), F.lit(True)),
        "session_p50": F.coalesce(F.col("p50") < p50, F.lit(True)), "session_p90": F.coalesce(F.col("p90") < p90, F.lit(True)),
    }
    reasons = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in tests.items())))
    return stats.withColumn("reasons", F.array_join(reasons, ",")).withColumn("status", F.when(F.col("reasons") == "", "PASS").otherwise("FAIL"))


def master_table(gated: DataFrame, lenient: tuple[str, ...] = ("plants",)) -> DataFrame:
    """The rows of all systems (system, reasons, and others) without the verdicts; refused while any system fails, where a bad ratio of the `lenient` ones doesn't count."""
    left = F.array_except(F.split("reasons", ","), F.when(F.col("system").isin(*lenient), F.array(F.lit("ratio"), F.lit(""))).otherwise(F.array(F.lit(""))))
    failed = gated.where(F.size(left) > 0).select("system", F.array_join(left, ",").alias("why")).orderBy("system").collect()  # one row for each system
    if failed:
        raise ValueError("the temporal gate is not passed: " + "; ".join(f"{r['system']}: {r['why']}" for r in failed))
    return gated.drop("reasons", "status").orderBy("system")


def write_csv(df: DataFrame, path: str) -> None:
    """A table of results as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_meta(df: DataFrame, path: str, **params) -> None:
    """One row of figures, with the parameters they came from, as JSON beside a result."""
    row = df.limit(1)
    for k, v in params.items():
        row = row.withColumn(k, F.lit(v))
    row.write.mode("overwrite").json(path)


def write_partition(part: DataFrame, path: str) -> None:
    """A partition (n, cluster) as lines of JSON, sorted by node within each file."""
    part.select("n", "cluster").repartitionByRange("n").sortWithinPartitions("n").write.mode("overwrite").json(path)


def append_edges(edges: DataFrame, path: str, **params) -> None:
    """Evidence on edges as lines of JSON, added to what is there."""
    for k, v in params.items():
        edges = edges.withColumn(k, F.lit(v))
    edges.write.mode("append").json(path)


def violin(df: DataFrame, by: str, cap: int = 5000, seed: int = 42) -> DataFrame:
    """Data of a violin plot: at most `cap` values (v) of each group, those with the least hashes; id tells the rows apart."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    return df.withColumn("_k", nth).where(F.col("_k") <= cap).select(by, "id", "v")


def chord(sim: DataFrame, part: DataFrame) -> DataFrame:
    """Data of a chord plot: a, b, weight, links between clusters (and within, a = b). part: n, cluster."""
    x = sim.where("v > 0").join(part.select(F.col("n").alias("i"), F.col("cluster").alias("ci")), "i").join(part.select(F.col("n").alias("j"), F.col("cluster").alias("cj")), "j")
    return x.groupBy(F.least("ci", "cj").alias("a"), F.greatest("ci", "cj").alias("b")).agg(F.sum("v").alias("weight"), F.count("*").alias("links"))


def panels(matrices: dict[str, DataFrame], part: DataFrame) -> DataFrame:
    """Data of a panel for each matrix: panel, a, b, mean and largest similarity by pairs of clusters."""
    out = None
    for name, sim in matrices.items():
        x = sim.join(part.select(F.col("n").alias("i"), F.col("cluster").alias("ci")), "i").join(part.select(F.col("n").alias("j"), F.col("cluster").alias("cj")), "j")
        one = x.groupBy(F.lit(name).alias("panel"), F.least("ci", "cj").alias("a"), F.greatest("ci", "cj").alias("b")).agg(F.avg("v").alias("mean"), F.max("v").alias("most"))
        out = one if out is None else out.union(one)
    return out
