"""A corpus pipeline: reject poor documents, cut repeated lines, keep one of each near-duplicate group, mix the sources, pack into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from seamline.llm import line_dedup, mixing, packing, quality, simhash
from seamline.llm.queries import tokenizer
from seamline.workspace import Workspace

#: Every stage but the classifier's decisions is beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from `labels` and the documents at hand, but never from held-out rows."""
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that the corpus has had before. A document all of whose words go is no longer one; n_chars follows the text."""
    cut = line_dedup.dedup_lines(docs)
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    left = cut.where(has_words | (F.col("n_removed") == 0))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: those joined by a similarity of 0.8 or more of their five-word shingles.

    The one with the smallest doc_id stays, and of rows with that id the first by content; of groups without any doc_id, one row.
    """
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id")
    found = simhash.similar_documents(docs)
    first = found.groupBy("label").agg(F.min(F.struct(known, "th")).alias("m")).select("m.id", "m.th")
    # The row travels as one column, so its names can't clash with those used here.
    rows = docs.select(F.struct("*").alias("row"), known, simhash.text_hash(F.col("text")).alias("th"))
    content = [F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # those have no hash
    nth = F.row_number().over(Window.partitionBy("id", "th").orderBy(F.xxhash64(*content)))
    return rows.join(first.hint("shuffle_hash"), ["id", "th"], "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Rows with equal doc_id, source and size share their copies by content."""
    copies = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.min("copies").alias("least"), F.sum("copies").alias("taken"), F.count("*").alias("n"))
    # The row travels as one column, so its names can't clash with those used here.
    a = docs.select(F.struct("*").alias("row"), "doc_id", "source", mixing.words(F.col("text")).alias("size"), "text")
    a = a.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("text"), "text"))).alias("a")
    b = copies.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))
    # The first rows take the copies that don't go round.
    times = F.col("least") + (F.col("nth") <= F.col("taken") - F.col("least") * F.col("n")).cast("long")
    joined = a.join(b, same).select("row", times.alias("times")).where("times > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document, each copy for itself."""
    return packing.pack_tables(docs, **tokenizer())[1]


STAGES = [("quality classifier", accept_quality), ("line dedup", cut_repeated_lines), ("SimHash near-dedup", keep_one_of_each), ("mixing sources", mix_sources), ("best-fit packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written before the next stage reads it."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.keep(docs, f"stage{i}")
    return docs
