"""Removal of lines in runs of three that the corpus has had before.

Every three consecutive lines with text are a window. Windows are hashed to 128 bits and counted over the whole corpus; the first one stays, and the lines
that later ones cover go, once for all windows over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seamline.operators.skew import join_counted
from seamline.workspace import Workspace

#: Windows sent at once.
FLUSH = 50_000
WINDOWS = "key binary, doc_id long, th long, first int, last int"


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """docs: doc_id, th, text. Windows by the hash of their lines (blanks at the ends of a line don't count), with the lines they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=["key", "doc_id", "th", "first", "last"])

        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2)):
                lines = (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                full = [(j, s) for j, x in enumerate(lines) if (s := x.strip())]
                for a in range(len(full) - size + 1):
                    part = full[a : a + size]
                    held.append((xxhash.xxh3_128_digest(b"\n".join([s for _, s in part])), ids[i], hashes[i], part[0][0], part[-1][0]))
                    if len(held) >= FLUSH:
                        yield out()
                        held.clear()
        if held:
            yield out()

    return docs.mapInArrow(run, WINDOWS)


def dedup_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """docs with text cut, and n_lines and n_removed (int) added; columns of docs with those names are replaced, others pass unchanged.

    Lines are split at line feeds; those without text are no part of a window, but go with a window around them. Windows are ordered by doc_id (null last),
    text hash and line, and all but the first of equal ones lose their lines. Windows are judged on the input. Fewer lines: nothing goes.
    A null text stays null. Equal rows are one document: they lose the same. A document may end up empty. No rows: none.
    """
    work = Workspace(docs.sparkSession, "lines")
    docs = docs.drop("n_lines", "n_removed")
    # The row travels as one column, so its names can't clash with those used here.
    base = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"))
    windows = work.keep(_windows(base.where("row.text is not null").select("id", "th", F.col("row.text").cast("string").alias("text")), size), "windows")
    order = F.struct("doc_id", "th", "first")
    heads = windows.groupBy("key").agg(F.min(order).alias("head"), F.max(order).alias("tail"), F.count("*").alias("n")).where("head <> tail").select("key", "head", "n")
    later = join_counted(windows, work.keep(heads, "heads"), "key", windows.count()).where(order != F.col("head")).select("doc_id", "th", "first", "last")
    spans = work.keep(later, "spans").groupBy(F.col("doc_id").alias("id"), "th").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    work.drop("windows", "heads")
    # The lines of few documents are looked up for many: no side is sorted, and the texts stay in the JVM.
    joined = base.join(spans.hint("shuffle_hash"), ["id", "th"], "left")
    lines = F.split(F.col("row.text").cast("string"), F.lit("\n"), -1)
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))))
    joined = joined.select("row", F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), covered.alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), "gone")
    cut = F.when(F.col("gone").isNull(), F.col("row.text").cast("string")).otherwise(F.array_join(_taken(lines, left), "\n"))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("int")
    return joined.select(*(cut.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns), F.col("n_lines").cast("int").alias("n_lines"), removed.alias("n_removed"))


def _taken(values: Column, places: Column) -> Column:
    """The values at the places, with the array of values made once."""
    return F.transform(F.array(values), lambda v: F.transform(places, lambda i: F.get(v, i)))[0]
