"""JSON dictionaries as rows: orders, labels, partitions, dependency maps, graphs; Markdown tables; inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seamline.operators import ranges
from seamline.sources.objects import json_texts


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_order(spark: SparkSession, path: str) -> DataFrame:
    """n, pos: a JSON array of names in its order."""
    return _whole(spark, path).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "n")).select("n", "pos")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """n, label: {name: label} or {label: [names]}."""
    entry = _whole(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    listed = F.col("v").startswith("[")
    flat = entry.where(~listed).select(F.col("k").alias("n"), F.col("v").alias("label"))
    return flat.union(entry.where(listed).select(F.explode(F.from_json("v", "array<string>")).alias("n"), F.col("k").alias("label")))


def read_dependencies(spark: SparkSession, path: str) -> DataFrame:
    """source, target, w: {source: {target: weight}}."""
    return _whole(spark, path).select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("source", "m")).select("source", F.explode("m").alias("target", "w"))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """source, target: the edges of {nodes, edges: [{source, target}]}."""
    schema = "nodes array<string>, edges array<struct<source:string,target:string>>"
    return _whole(spark, path).select(F.explode(F.from_json("value", schema)["edges"]).alias("e")).select("e.source", "e.target")


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array, of lines of JSON, or of objects written one after another."""
    return json_texts(spark, path).select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths that exists, in whatever store they are."""
    return next((p for p in paths if _status(spark, p) is not None), None)


def newest(spark: SparkSession, paths: list[str]) -> str | None:
    """The path changed last; of equal times the first."""
    found = [(s, -k, p) for k, p in enumerate(paths) if (s := _status(spark, p)) is not None]
    return max(found)[2] if found else None


def _status(spark: SparkSession, path: str) -> int | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.getFileStatus(target).getModificationTime() if store.exists(target) else None


def scraped(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One row: for each pattern the first group of its last match in lines (seq, value) of a program's output, as a number; null without one."""
    out = []
    for name, p in patterns.items():
        hit = F.col("value").rlike(p)
        out.append(F.max(F.when(hit, F.struct("seq", F.regexp_extract("value", p, 1).try_cast("double").alias("x"))))["x"].alias(name))
    return lines.agg(*out)


def read_latest(spark: SparkSession, pattern: str, system: str) -> DataFrame:
    """system, and the columns of a CSV file, from the newest file of each system. pattern: a path with * ; system: a regular expression whose first group is the system in a path."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime", F.regexp_extract("path", system, 1).alias("system")).where("system <> ''")
    latest = files.groupBy("system").agg(F.max(F.struct("modificationTime", "path"))["path"].alias("path"))
    rows = spark.read.option("header", True).csv(pattern).withColumn("_path", F.col("_metadata.file_path"))
    same = F.regexp_replace(F.col("_path"), "^file:/+", "/") == F.regexp_replace(F.col("path"), "^file:/+", "/")
    return rows.join(F.broadcast(latest), same).drop("_path", "path")  # one row for each system


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """cells (array) of each row of the Markdown tables in a file, head rows included, rules not."""
    rows = spark.read.text(path).where(F.startswith(F.trim("value"), F.lit("|")) & ~F.col("value").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return rows.select(cells.alias("cells"))


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, lines, sha of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    newline = F.length(F.regexp_replace(F.decode("content", "ISO-8859-1"), r"[^\n]", ""))
    return files.select("path", F.col("length").alias("bytes"), newline.cast("long").alias("lines"), F.sha2("content", 256).alias("sha"))


def class_dim(names: DataFrame) -> DataFrame:
    """node_id, fqcn: distinct names by code point."""
    return ranges.ranked(names.select("fqcn").distinct(), [F.col("fqcn")]).select(F.col("nth").cast("int").alias("node_id"), "fqcn")


def write_matrix(sim: DataFrame, path: str, system: str, modality: str) -> None:
    """A matrix in long form, by system and modality."""
    sim.withColumn("system", F.lit(system)).withColumn("modality", F.lit(modality)).write.mode("append").partitionBy("system", "modality").parquet(path)


def fingerprint(sim: DataFrame) -> DataFrame:
    """One row: a hash of a matrix's size and statistics, 16 hex digits, whatever its order of rows."""
    row = sim.agg(F.count("*").alias("n"), F.round(F.sum("v"), 9).alias("s"), F.round(F.sum(F.col("v") * F.col("v")), 9).alias("q"), F.round(F.min("v"), 9).alias("a"), F.round(F.max("v"), 9).alias("b"))
    return row.select(F.substring(F.sha2(F.concat_ws(",", "n", "s", "q", "a", "b"), 256), 1, 16).alias("fingerprint"))


def archive(spark: SparkSession, paths: list[str], folder: str, empty: bool = False) -> list[str]:
    """Copy files or folders of results into a run's folder, in whatever stores they are; the copies that were made. Missing ones are skipped, and a copy that is there stays. empty: cut copied files to no bytes."""
    jvm, conf, made = spark._jvm, spark._jsc.hadoopConfiguration(), []
    target = jvm.org.apache.hadoop.fs.Path(folder)
    store = target.getFileSystem(conf)
    store.mkdirs(target)
    for p in paths:
        source = jvm.org.apache.hadoop.fs.Path(p)
        own, copy = source.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path(target, source.getName())
        if not own.exists(source) or store.exists(copy):
            continue
        jvm.org.apache.hadoop.fs.FileUtil.copy(own, source, store, copy, False, conf)
        made.append(copy.toString())
        if empty and own.getFileStatus(source).isFile():
            own.create(source, True).close()
    return made
