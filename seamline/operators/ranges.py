"""Running sums and ranks over a whole table in a global order, without a task that sees all rows.

Rows are dealt out by ranges of the order; what the ranges before hold comes from one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from seamline.workspace import Workspace


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with a column for each of sums: its sum over the rows before, 0 for the first. Rows that are equal in the order should be equal in all."""
    work = Workspace(df.sparkSession, "ranges")
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    table = work.keep(dealt.select(*df.columns, "_range", *(c.alias(f"_own_{a}") for a, c in sums.items())), "dealt")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = table.groupBy("_range").agg(*(F.sum(f"_own_{a}").alias(a) for a in sums))
    before = totals.select("_range", *(F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"_before_{a}") for a in sums))
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = table.join(F.broadcast(before), "_range")
    return out.select(*df.columns, *((F.col(f"_before_{a}") + F.coalesce(F.sum(f"_own_{a}").over(here), F.lit(0))).alias(a) for a in sums))


def ranked(df: DataFrame, order: list[Column], name: str = "nth") -> DataFrame:
    """df with each row's place in the order, from 0."""
    return running(df, order, {name: F.lit(1).cast("long")})


def quantiles(df: DataFrame, shares: list[float], value: str = "v", weight: Column | None = None) -> DataFrame:
    """One row q: the values at the shares of all rows (an array), between two values by linear interpolation; null for no rows.

    A row counts `weight` times. Equal values are one row before anything is ordered, and places come from running sums over ranges of values, so no task holds all of them.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("w")).where("w > 0")
    placed = running(counted, [F.col("v")], {"before": F.col("w")})
    total = counted.agg(F.sum("w").alias("total"))  # one row
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("w")), F.col("v")))
    out = []
    for q in shares:
        place = F.lit(float(q)) * (F.col("total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        out.append(low + (high - low) * part)
    return placed.join(F.broadcast(total)).agg(F.array(*out).alias("q"))
