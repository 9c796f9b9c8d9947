"""How filters interact: what each removes in every order, from 32 counts a part, with DataFrame functions only.

Five filters judge a document; a bit for each that it fails makes its mask. Whatever the order, what a filter removes, leaves or would have removed follows from how many documents
have each mask, so all 120 orders are read off the 32 counts of a part and no order runs over the documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: A: short; B: few distinct words; C: capitals; D: symbols; E: a copy. The kth letter is bit k of a mask.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text fails by itself (A to D); null counts as empty. Words are maximal runs without ASCII white space."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    parts = F.split(F.translate(t, "\t\n\x0b\x0c\r", "     "), " ", -1)
    n, distinct = F.size(F.array_remove(parts, "")), F.size(F.array_remove(F.array_distinct(parts), ""))
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    fails = [n < 50, 100 * distinct.cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.length(t).cast("long"), t.rlike(r"[#$%&*|]")]
    mask = F.lit(0)
    for k, f in enumerate(fails):
        mask = mask + F.when(f, 1 << k).otherwise(0)
    return mask


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the filters they fail, and how many of them are labelled so.

    docs: doc_id, text, source (the part; null: empty). labels: doc_id, quality, toxic; a doc_id that has several rows is good or toxic if one says so, and a null doc_id or label says nothing.
    E fails where a smaller doc_id has the same text, null texts being empty ones; texts are compared by length and SHA-256. A null doc_id is never smaller and never fails E; repeated rows of the first doc_id
    don't fail it. Other columns are ignored; no documents: no rows.

    Texts leave the scan as 32 bytes. Rows of a text are counted by part and label before its first doc_id is sought, so a text that a third of all rows has is a few rows by then: one for each part and label.
    """
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    text, id_ = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    rows = docs.select(
        id_.alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).alias("size"),
        F.when(id_.isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(0).alias("salt"),  # null ids join nothing, and are dealt out evenly
    )
    joined = rows.join(said.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").withColumn("good", F.coalesce("good", F.lit(False))).withColumn("toxic", F.coalesce("toxic", F.lit(False)))
    # Repeated rows first, where the join has put them; then the rows of each text by part and label.
    once = joined.groupBy("id", "salt", "digest", "size", "mask", "part", "good", "toxic").agg(F.count("*").alias("n"))
    known = F.col("id").isNotNull()
    texts = once.groupBy("digest", "size", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"))
    first = F.min("least").over(Window.partitionBy("digest", "size"))
    copies = F.col("known") - F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    split = texts.withColumn("first", first).withColumn("copies", copies)
    each = F.explode(F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), F.col("copies").alias("n"))))
    counted = split.select("part", "good", "toxic", each.alias("cell")).select("part", "cell.mask", "cell.n", F.when(F.col("good"), F.col("cell.n")).otherwise(0).alias("good"), F.when(F.col("toxic"), F.col("cell.n")).otherwise(0).alias("toxic"))
    return counted.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step (from 1), kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order of the filters, from cells (part, mask, n, good, toxic).

    shapley adds up what the step's filter removes over all orders: of the filters that a document fails, each comes first in the same share of them.
    """
    orders = ["".join(p) for p in permutations(filters)]
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    steps = F.sequence(F.lit(1), F.lit(len(filters)))
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " "))).withColumn("step", F.explode(steps))
    place = {f: F.instr("filter_order", f) for f in filters}
    bits = lambda test: sum((F.when(test(place[f]), 1 << k).otherwise(0) for k, f in enumerate(filters)), F.lit(0))
    rows = rows.withColumn("bit", bits(lambda p: p == F.col("step"))).withColumn("before", bits(lambda p: p < F.col("step")))
    zero, bit, before = F.lit(0).cast("long"), F.col("bit"), F.col("before")
    total = lambda test, value: F.aggregate("cells", zero, lambda a, c: a + F.when(test(c["mask"]), value(c)).otherwise(zero))
    fails, earlier = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~earlier(m)
    turns = F.lit(len(orders))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~earlier(m), lambda c: c["n"]).alias("kept"), total(here, lambda c: c["n"]).alias("removed"), total(lambda m: fails(m) & earlier(m), lambda c: c["n"]).alias("redundant"),
        total(lambda m: m == bit, lambda c: c["n"]).alias("unique_fails"), total(here, lambda c: c["good"]).alias("good_lost"), total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["n"] * F.floor(turns / F.bit_count(c["mask"]))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of cells()."""
    return interactions(cells(docs, labels))
