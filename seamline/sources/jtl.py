"""Load-test event logs: CSV of 17 or 18 columns, with or without a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: The column names of the log format, in file order.
COLUMNS = (
    "timeStamp", "elapsed", "label", "responseCode", "responseMessage", "threadName", "dataType", "success", "failureMessage",
    "bytes", "sentBytes", "grpThreads", "allThreads", "URL", "Latency", "IdleTime", "Connect", "threadIteration",
)
_WHOLE = {"timeStamp", "elapsed", "bytes", "sentBytes", "grpThreads", "allThreads", "Latency", "IdleTime", "Connect", "threadIteration"}


def read_jtl(spark: SparkSession, path: str, max_rows: int = 0) -> DataFrame:
    """COLUMNS with whole numbers cast (null where they can't be) and seq, the place of the row. A first line that names label and timeStamp is a header.

    Short rows have nulls at their end. A header is recognised and its names are used, in any order and case. max_rows: only the first ones, in the file's order; 0: all.
    """
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    header = "label" in line.lower() and "timestamp" in line.lower()
    names = [c.strip().strip('"') for c in line.split(",")] if header else list(COLUMNS)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    raw = raw.withColumn("_seq", F.monotonically_increasing_id())
    lower = {c.lower(): c for c in names}
    out = []
    for c in COLUMNS:
        col = F.col(f"`{lower[c.lower()]}`") if c.lower() in lower else F.lit(None).cast("string")
        out.append((col.try_cast("long") if c in _WHOLE else col).alias(c))
    rows = raw.select(*out, F.col("_seq").alias("seq"))
    return rows.orderBy("seq").limit(max_rows) if max_rows else rows


def read_positional(spark: SparkSession, path: str) -> DataFrame:
    """t, label, url, seq by their places in a log without a header, in order of time; rows of the controllers Flow... and Transaction... are left out."""
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(COLUMNS))])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("escape", '"').csv(path).withColumn("seq", F.monotonically_increasing_id())
    rows = raw.select(F.col("c0").try_cast("long").alias("t"), F.col("c2").alias("label"), F.coalesce("c13", F.lit("")).alias("url"), "seq")
    return rows.where("label is not null and not startswith(label, 'Flow') and not startswith(label, 'Transaction')").orderBy("t", "seq")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, its kinds inferred."""
    return spark.read.option("header", True).option("inferSchema", True).option("escape", '"').csv(path)


def transactions(rows: DataFrame) -> DataFrame:
    """Successful samples with labels T_..., whose time and duration are numbers."""
    ok = F.lower("success").isin("true", "1", "t", "yes")
    return rows.where(F.startswith("label", F.lit("T_")) & ok & F.col("timeStamp").isNotNull() & F.col("elapsed").isNotNull())
