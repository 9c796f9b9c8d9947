"""Best-fit decreasing packing of token sequences.

Lengths are whole numbers up to the capacity, so a histogram of lengths (at most `capacity` rows,
whatever the corpus) decides the packing. The driver packs the histogram with a segment tree over
remaining capacities; each piece then finds its place from its rank among the pieces of its length.
Ranks come from counts of (length, slot) with the slot a hash of the piece's whole row, so a length that a third
of all pieces share is ranked in many tasks, even if their doc_id is one or null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from seamline.workspace import Workspace

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()), T.StructField("ids_crc32", T.LongType()),
])

#: Characters for which both tokenizer libraries are known to cut words alike; others take the slower one.
_PLAIN_LIMIT = 0x250


class Tokens:
    """ids of a text: those that `tokenizers` gives for the file, then the separator.

    The same vocabulary as ranks runs about six times as fast. It is used for texts of Latin letters and
    common punctuation, where the two libraries' tables of letters, digits and spaces can't differ.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str, special: dict[str, int], separator: int):
        self.json_path, self.special, self.separator, self.fast, self.slow = json_path, special, separator, None, None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        out = np.asarray(self._ids(text), "<u4")
        return np.append(out, np.uint32(self.separator)).astype("<u4", copy=False)

    def _ids(self, text: str) -> np.ndarray | list[int]:
        if self.fast and not any(s in text for s in self.special) and self._plain(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        if self.slow is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return self.slow.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _plain(text: str) -> bool:
        if text.isascii():
            return True
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return bool(((points < _PLAIN_LIMIT) | ((points >= 0x2010) & (points <= 0x2027))).all())


@lru_cache(maxsize=2)
def loaded(json_path: str, ranks_path: str | None, pattern: str, special: tuple[tuple[str, int], ...], separator: int) -> Tokens:
    """The tokenizer, read once for a Python worker however many partitions it has."""
    return Tokens(json_path, ranks_path, pattern, dict(special), separator)


def tokenise(docs: DataFrame, json_path: str, ranks_path: str | None, pattern: str, special: dict[str, int], capacity: int = 2048, separator: int = 0) -> DataFrame:
    """Rows of docs (doc_id, text) as pieces of at most `capacity` ids: PIECES.

    A null text is an empty one: its only id is the separator. A longer document is cut from its end into full pieces,
    so its first piece may be shorter. Repeated rows and null doc_ids are documents like others.
    """

    named = tuple(sorted(special.items()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        tokens = loaded(json_path, ranks_path, pattern, named, separator)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = tokens.ids(text.as_py() or "").tobytes()
                n = len(data) // 4
                bounds = sorted({0, *range(n, 0, -capacity)})
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    part = data[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, part, zlib.crc32(part)))
                held += len(data)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


class CapacityTree:
    """A segment tree over remaining capacities: which of them have an open bin."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.size, bool)
        self.bins: list[list[list[int]]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, first: int, count: int) -> None:
        """Open bins first .. first + count - 1 with so much room each."""
        if self.bins[remaining]:
            self.bins[remaining].append([first, count])
            return
        self.bins[remaining].append([first, count])
        at = self.size + remaining
        while at and not self.any[at]:
            self.any[at] = True
            at //= 2

    def tightest(self, need: int) -> int:
        """The smallest remaining capacity of an open bin that is at least `need`; -1: none."""
        at = self.size + need
        if self.any[at]:
            return need
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return -1

    def take(self, remaining: int) -> list[int]:
        run = self.bins[remaining].pop()
        if not self.bins[remaining]:
            at = self.size + remaining
            self.any[at] = False
            while at > 1 and not (self.any[at] or self.any[at ^ 1]):
                at //= 2
                self.any[at] = False
        return run


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, pieces, pieces a bin, first bin, offset in the bin), by length and rank.

    It is the packing that best-fit decreasing makes one piece after another: the tightest bin that takes a
    length is filled with that length until it takes no more, so runs of equal bins are filled alike.
    """
    tree, plan, bins = CapacityTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                (first, n), each = tree.take(room), room // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, full * each, each, first, capacity - room))
                rank, left = rank + full * each, left - full * each
                if room % length:
                    tree.put(room - each * length, first, full)
                first, n = first + full, n - full
            if n and left:  # the last bin of this length, not filled
                plan.append((length, rank, left, left, first, capacity - room))
                if room - left * length:
                    tree.put(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            if n:
                tree.put(room, first, n)
    return plan


def pack(pieces: DataFrame, capacity: int = 2048, slot_rows: int = 50_000) -> DataFrame:
    """pieces (doc_id, piece, length, and others) with sequence_id and offset, both long.

    Sequences hold at most `capacity`, without gaps. Clashing columns sequence_id and offset are replaced. A null length or one below 1 or over the
    capacity gets nulls. No pieces: no rows. Equal rows are separate pieces. `pieces` must give the same rows each time it is read (a table).
    About `slot_rows` pieces of one length are ranked together.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    fits = F.col("length").between(1, capacity)
    histogram = {int(n): int(k) for n, k in pieces.where(fits).groupBy("length").count().collect()}  # at most `capacity` rows
    slots = max(64, -(-max(histogram.values(), default=0) // slot_rows))
    hashed = [F.col(f"`{c}`") for c, kind in pieces.dtypes if "map<" not in kind and "variant" not in kind]  # those have no hash
    # The row travels as one column, so its names can't clash with those used here.
    slotted = pieces.select(F.struct("*").alias("row"), "doc_id", "piece", F.col("length").cast("long").alias("length"), F.pmod(F.xxhash64(*hashed), F.lit(slots)).alias("slot"))
    counts = slotted.where(fits).groupBy("length", "slot").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("slot")) - F.col("n")).drop("n")
    plan = best_fit_plan(histogram, capacity)
    table = np.array(plan, np.int64).reshape(-1, 6)
    keys = (table[:, 0] << 44) + table[:, 1]
    order = np.argsort(keys, kind="stable")
    keys, table = keys[order], table[order]
    names = pieces.columns
    held = spark.sparkContext.broadcast((keys, table))  # its size follows the capacity, not the pieces

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = held.value
        for batch in batches:
            row, length, rank = batch.columns
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            known = np.asarray(rank.is_valid())
            if known.any():
                n, r = np.asarray(length.fill_null(0))[known], np.asarray(rank.fill_null(0))[known]
                at = table[np.searchsorted(keys, (n << 44) + r, "right") - 1]
                nth = r - at[:, 1]
                sequence[known], offset[known] = at[:, 4] + nth // at[:, 3], at[:, 5] + nth % at[:, 3] * n
            yield pa.RecordBatch.from_arrays([*row.flatten(), *(pa.array(x, mask=~known) for x in (sequence, offset))], names=[*names, "sequence_id", "offset"])

    within = Window.partitionBy("length", "slot").orderBy("doc_id", "piece")
    ranked = slotted.withColumn("nth", F.row_number().over(within) - 1).join(before, ["length", "slot"], "left")
    ranked = ranked.select("row", "length", F.when(fits, F.col("nth") + F.col("before")).alias("rank"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def pack_tables(docs: DataFrame, json_path: str, ranks_path: str | None, pattern: str, special: dict[str, int], capacity: int = 2048, separator: int = 0) -> tuple[DataFrame, DataFrame]:
    """Tokenise and pack all of docs: the written table of pieces with their ids (PIECES), and the place of every piece.

    The second has the columns of the first but ids, which no shuffle carries, and sequence_id and offset. tokenise() says what nulls,
    empty and long texts and repeated rows give; other columns of docs are ignored.
    """
    pieces = Workspace(docs.sparkSession, "packing").keep(tokenise(docs, json_path, ranks_path, pattern, special, capacity, separator), "pieces")
    return pieces, pack(pieces.drop("ids"), capacity)
