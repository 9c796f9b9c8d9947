"""Mixing of sources to target weights by pivotal dependent rounding.

A source's documents are taken at one rate: each floor(rate) times, and once more with the rest as probability. Pairs of documents
trade words of probability at random until one of them is settled, so the expectation of each stays and the words of the source come out
at its target, up to one document. Groups of bounded size settle all but one document each, and what is left goes up a tree of groups.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.operators import ranges
from seamline.workspace import Workspace

WORDS = r"[^\x20\x09-\x0D]+"
ROWS = "doc_id long, source string, size long, n long, p double, extra long"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("n", pa.int64()), ("p", pa.float64()), ("extra", pa.int64())])
COLUMNS = SCHEMA.names


def words(text) -> F.Column:
    """Words of a text; none in a null one."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0) -> DataFrame:
    """source, source_size, target, rate: one row for each source of sizes (source, size).

    Sources by code point, null last, get the weights in turn. They share `share` of all sizes by weight; none gets more than `most` times its size,
    and the excess goes to the others by weight until none is above. Those below then share what the capped leave at one level for each
    weight, so the level follows from sums over the sources in order of their cap for each weight.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = F.col("source").asc_nulls_last()
    nth = ranges.ranked(table, [named])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    table = nth.select("source", "source_size", weight.alias("w")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    before = ranges.running(table, [(F.col("cap") / F.col("w")).asc(), named], {"cap_before": F.col("cap"), "w_before": F.col("w")})
    every = table.agg(F.sum("source_size").alias("all"), F.sum("w").alias("w_all"))  # one row
    level = (F.lit(float(share)) * F.col("all") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))  # if those before are capped
    levels = before.join(F.broadcast(every)).withColumn("level", level)
    # The level is that of the first source that stays below its cap.
    first = levels.where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min(F.struct(F.col("cap") / F.col("w"), "source", "level"))["level"].alias("first"))  # one row
    target = F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("first") * F.col("w")))
    rate = F.when(F.col("target") >= F.col("cap"), F.lit(float(most))).when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return table.join(F.broadcast(first)).withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def settle(doc_id: list[int | None], source: str | None, size: list[int], p: list[float], seed: int, last: bool) -> list[float]:
    """Probabilities of one group's documents, in order of size, settled to 0 or 1; at most one keeps its own, and none if it is the last group of its source."""
    p = list(p)
    coin = random.Random(zlib.crc32(f"{seed}/{source!r}/{len(p)}/{doc_id[0]}".encode()))
    open_ = -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if open_ < 0:
            open_ = i
            continue
        a, b = size[open_] * p[open_], size[i] * p[i]
        up, down = min(size[open_] - a, b), min(a, size[i] - b)  # words that can go to the open document, and from it
        if coin.random() * (up + down) < down:
            if size[open_] - a <= b:
                p[open_], p[i] = 1.0, (b - up) / size[i]
            else:
                p[open_], p[i] = (a + up) / size[open_], 0.0
        elif a <= size[i] - b:
            p[open_], p[i] = 0.0, (b + down) / size[i]
        else:
            p[open_], p[i] = (a - down) / size[open_], 1.0
        open_ = next((j for j in (open_, i) if 0 < p[j] < 1), -1)
    if last and open_ >= 0:
        p[open_] = float(coin.random() < p[open_])
    return p


def _settled(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    """rows (COLUMNS and _g) with p settled group by group of (source, _g) and moved into extra. Groups stream one after another, so many small ones cost no more than a few large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the group that may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            yield from done(table, False)
            rest = table.slice(starts(table)[-1]) if len(table) else None
        if rest is not None:
            yield from done(rest, True)

    def starts(table: pa.Table) -> list[int]:
        """Where the groups begin."""
        source, g = table.column("source").combine_chunks().dictionary_encode(), np.asarray(table.column("_g"))
        code = np.asarray(source.indices.fill_null(-1))
        return np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (g[1:] != g[:-1])])).tolist()

    def done(table: pa.Table, ended: bool) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        first = starts(table)
        ends = [*first[1:], *([len(table)] if ended else [])]
        stop = ends[-1] if ends else 0
        table = table.slice(0, stop)
        if not stop:
            return
        doc_id, source, size, p = (table.column(c).to_pylist() for c in ("doc_id", "source", "size", "p"))
        out = []
        for lo, hi in zip(first, ends):
            out += settle(doc_id[lo:hi], source[lo], size[lo:hi], p[lo:hi], seed, last)
        out = np.array(out)
        extra = np.asarray(table.column("extra")) + (out >= 1)
        columns = [table.column(c) for c in COLUMNS[:4]] + [pa.array(np.where(out >= 1, 0.0, np.maximum(out, 0.0))), pa.array(extra)]
        yield from pa.table(columns, schema=SCHEMA).combine_chunks().to_batches()

    order = [F.col("source"), F.col("_g"), F.col("size").desc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("n"), F.col("p")]
    return rows.select(*COLUMNS, "_g").repartition("source", "_g").sortWithinPartitions(*order).mapInArrow(run, ROWS)


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0, group: int = 500, seed: int = 7) -> DataFrame:
    """doc_id, size, source, source_size, target, copies for each row of docs (doc_id, text, source): how often the mix takes it.

    size: words of the text (null: 0). Documents without words are never taken. Rows with the same doc_id, source and size stand for each other: the
    number of their copies is settled together. Null doc_ids are ids like others, and ids keep all their digits. Empty input: no rows. Other columns are ignored. Reruns give
    the same copies, whatever the partitions.
    """
    work = Workspace(docs.sparkSession, "mixing")
    # Equal rows become one before anything is dealt out.
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
    sizes = work.keep(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    weighed = sizes.select("source", (F.col("size") * F.col("n")).alias("size"))
    targets = work.keep(source_targets(weighed, share, weights, most), "targets")
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    rated = sizes.alias("s").join(targets.alias("t"), same).select("doc_id", "s.source", "size", "n", "rate")
    taken = F.when(F.col("size") > 0, F.col("n") * (F.col("rate") - F.floor("rate"))).otherwise(F.lit(0.0))
    rows = rated.withColumn("f", taken).select("doc_id", "source", "size", "n", (F.col("f") - F.floor("f")).alias("p"), F.floor("f").cast("long").alias("extra"))
    most_rows = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    done, level = [], 0
    while True:
        groups = max(1, -(-most_rows // group))
        last = groups == 1

        spread = rows.withColumn("_g", F.pmod(F.xxhash64("doc_id", "size", F.lit(level)), F.lit(groups)))
        settled = work.keep(_settled(spread, seed + level, last), f"level{level}")
        done.append(settled.where("p = 0"))
        if last:
            break
        rows, most_rows, level = settled.where("p > 0"), groups, level + 1
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    # One row for each document again: the first `extra` of equal rows get one copy more.
    step = 4096
    parts = every.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / step))))
    nth = F.explode(F.sequence(F.col("_k") * step + 1, F.least("n", (F.col("_k") + 1) * step))).alias("nth")
    each = parts.select("doc_id", "source", "size", "extra", nth)
    out = each.alias("s").join(targets.alias("t"), same)
    copies = F.when(F.col("size") > 0, F.floor("rate").cast("long")).otherwise(F.lit(0)) + (F.col("nth") <= F.col("extra")).cast("long")
    return out.select("doc_id", "size", F.col("s.source").alias("source"), "source_size", "target", copies.alias("copies"))
