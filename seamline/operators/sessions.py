"""Sessions and windows over ordered events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from seamline.workspace import Workspace


def anchored_sessions(events: DataFrame, cap_ms: int) -> DataFrame:
    """g, seq, t, n, session (from 0 in each group): a session ends with the first event more than cap_ms after its own first event.

    events: g, seq, t (ms), n, taken in order of g, seq. A missing or negative t neither opens nor splits a session; a cap of 0 or less never splits.
    Rows stream through sorted partitions and only the open session is remembered, so a group of any size takes no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor, session = None, None, 0  # of the group that may go on in the next batch
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            code = np.asarray(codes.indices.fill_null(-1))
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            times = np.asarray(batch.column(2).fill_null(-1)).astype(np.int64)
            out = np.empty(len(batch), np.int64)
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(code)]):
                group = (batch.column(0)[lo].as_py(),)
                if group != last:
                    last, anchor, session = group, None, 0
                anchor, session = _split(times[lo:hi], out[lo:hi], anchor, session, cap_ms)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "session"])

    rows = events.select("g", "seq", "t", "n")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition("g").sortWithinPartitions("g", "seq").mapInArrow(run, f"{schema}, session long")


def stream_sessions(events: DataFrame, cap_ms: int, ranges: int | None = None) -> DataFrame:
    """seq, t, n, session: anchored_sessions() of one stream without groups, by many tasks. events: seq (tells rows apart), t (ms), n.

    The stream is cut into `ranges` of seq (by default as many as a shuffle has). Only times above all earlier ones of a range can open a session there, so where a range leaves the stream follows from the
    time at which the first of them opens one: a function of few steps, as sessions that begin apart soon end together. The steps of all ranges are walked through in order; then each range splits its own rows.
    """
    work = Workspace(events.sparkSession, "stream")
    rows = events.select("seq", "t", "n")
    dealt = rows.repartitionByRange("seq") if ranges is None else rows.repartitionByRange(ranges, "seq")
    table = work.keep(dealt.withColumn("_range", F.spark_partition_id()), "dealt")

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(part: int, times: list[np.ndarray]) -> pa.RecordBatch:
            t = np.concatenate(times)
            t = t[t >= 0]
            high = np.unique(np.maximum.accumulate(t)) if len(t) else t
            if not len(high):  # stays as it is entered
                return pa.RecordBatch.from_pydict({"_range": pa.array([part], pa.int32()), "below": [-1], "anchor": [-1], "added": [0]})
            out, added = _ends(high, cap_ms)
            last = np.flatnonzero(np.concatenate([(out[1:] != out[:-1]) | (added[1:] != added[:-1]), [True]]))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(last), part, np.int32)), pa.array(high[last]), pa.array(out[last]), pa.array(added[last])], names=["_range", "below", "anchor", "added"])

        now, held = None, []
        for batch in batches:
            part, t = np.asarray(batch.column(0)), np.asarray(batch.column(1).fill_null(-1)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
                if part[lo] != now:
                    if held:
                        yield of(now, held)
                    now, held = int(part[lo]), []
                held.append(t[lo:hi])
        if held:
            yield of(now, held)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, session, now, found = None, 0, None, False
        for batch in batches:
            out = []
            for part, below, end, added in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    out.append((part, anchor, session))
                    now, found = part, False
                if added and not found and (anchor is None or (cap_ms > 0 and anchor + cap_ms < below)):
                    session += added - (anchor is None)
                    anchor, found = end, True
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out) if out else ((), (), ()), (pa.int32(), pa.int64(), pa.int64()))], names=["_range", "_anchor", "_session"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchor, session = None, None, 0
        for batch in batches:
            part, out = np.asarray(batch.column(3)), np.empty(len(batch), np.int64)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            times = np.asarray(batch.column(1).fill_null(-1)).astype(np.int64)
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
                if part[lo] != now:
                    now, anchor, session = part[lo], batch.column(4)[lo].as_py(), batch.column(5)[lo].as_py()
                anchor, session = _split(times[lo:hi], out[lo:hi], anchor, session, cap_ms)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out)], names=["seq", "t", "n", "session"])

    order = ("_range", "seq")
    stepped = table.select("_range", "t", "seq").repartition("_range").sortWithinPartitions(*order).select("_range", "t").mapInArrow(steps, "_range int, below long, anchor long, added long")
    entered = stepped.repartition(1).sortWithinPartitions("_range", "below").mapInArrow(walk, "_range int, _anchor long, _session long")  # one row for each range
    begun = table.join(F.broadcast(work.keep(entered, "entered")), "_range").select("seq", "t", "n", "_range", "_anchor", "_session")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return begun.repartition("_range").sortWithinPartitions(*order).mapInArrow(split, f"{schema}, session long")


def _ends(high: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For sessions that open at each of a range's rising times: the first event of the range's last session, and how many sessions open. By jumps of doubled length."""
    nxt = np.searchsorted(high, high + cap, "right") if cap > 0 else np.full(len(high), len(high))
    opened = (nxt < len(high)).astype(np.int64)
    nxt = np.where(nxt < len(high), nxt, np.arange(len(high)))  # the last session leads to itself
    while ((far := nxt[nxt]) != nxt).any():
        opened, nxt = opened + opened[nxt], far
    return high[nxt], opened + 1


def _split(t: np.ndarray, out: np.ndarray, anchor: int | None, session: int, cap: int) -> tuple[int | None, int]:
    """Sessions of one group's events into out, from where the group stands; its new state. Negative times neither open nor split. Goes from one first event to the next."""
    known = np.flatnonzero(t >= 0)
    high = np.maximum.accumulate(t[known]) if len(known) else t[:0]  # the first time above a limit is the first running maximum above it
    at = 0
    while at < len(t):
        if anchor is None:
            nxt = int(known[0]) if len(known) else len(t)
            out[at:nxt] = session
            if nxt == len(t):
                return None, session
            anchor, at = int(t[nxt]), nxt
        first = int(np.searchsorted(known, at))
        nxt = len(t)
        if cap > 0 and first < len(known):
            # times before `at` count in the maxima; where they hide the place, the rest is looked at by itself
            if first and high[first - 1] > anchor + cap:
                over = np.flatnonzero(t[known[first:]] > anchor + cap)
                nxt = int(known[first + over[0]]) if len(over) else len(t)
            else:
                k = int(np.searchsorted(high, anchor + cap, "right"))
                nxt = int(known[k]) if k < len(known) else len(t)
        out[at:nxt] = session
        if nxt < len(t):
            anchor, session = int(t[nxt]), session + 1
        at = nxt
    return anchor, session


def count_windows(rows: DataFrame, size: int, stride: int) -> DataFrame:
    """g, w, seq, n: full windows of `size` consecutive items of a group, one every `stride`. rows: g, seq, n."""
    order = Window.partitionBy("g").orderBy("seq")
    r = rows.withColumn("_k", F.row_number().over(order) - 1).withColumn("_all", F.count("*").over(Window.partitionBy("g")))
    first = F.greatest(F.lit(0), F.ceil((F.col("_k") - size + 1) / stride))
    last = F.least(F.floor(F.col("_k") / stride), F.floor((F.col("_all") - size) / stride))
    spans = F.when(last >= first, F.sequence(first, last))
    return r.withColumn("w", F.explode(spans)).select("g", "w", "seq", "n")


#: What a stream of requests is cut by: see group_key().
GROUPS = ("thread_iteration", "thread", "global")


def group_key(thread, iteration, mode: str = "thread_iteration"):
    """The thread, or thread::it=k where an iteration is known; by `mode` the thread alone, or one key for all (stream_sessions() splits that by many tasks)."""
    if mode not in GROUPS:
        raise ValueError(f"mode must be one of {', '.join(GROUPS)}")
    if mode == "global":
        return F.lit("global")
    if mode == "thread":
        return thread
    return F.when(iteration >= 0, F.concat(thread, F.lit("::it="), iteration.cast("string"))).otherwise(thread)


def with_min_items(sessions: DataFrame, least: int) -> DataFrame:
    """Sessions (g, session) of at least so many items, repeats counted."""
    busy = sessions.groupBy("g", "session").agg(F.count("*").alias("_c")).where(F.col("_c") >= least).drop("_c")
    return sessions.join(busy, ["g", "session"], "left_semi")


def coverage(sessions: DataFrame) -> DataFrame:
    """n, coverage: share of the sessions (g, session) that have the node."""
    total = sessions.select("g", "session").distinct().agg(F.count("*").alias("total"))
    per = sessions.select("g", "session", "n").distinct().groupBy("n").agg(F.count("*").alias("c"))
    return per.join(F.broadcast(total)).select("n", (F.col("c") / F.col("total")).alias("coverage"))  # one row


def hit_percentiles(sessions: DataFrame) -> DataFrame:
    """sessions, p50, p90 of distinct nodes a session."""
    hits = sessions.select("g", "session", "n").distinct().groupBy("g", "session").agg(F.count("*").alias("h"))
    q = F.percentile("h", F.array(F.lit(0.5), F.lit(0.9)))
    return hits.agg(F.count("*").alias("sessions"), q.alias("q")).select("sessions", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"))


def gate_sessions(rows: DataFrame, cap: int = 0, least: int = 1) -> DataFrame:
    """g, seq, n: the gate's sessions, by thread and iteration (or the group's threads where the iteration is unknown) without a time limit. rows: threadName, threadIteration, grpThreads, seq, n.

    cap: only the first so many events of a session, 0: all. Sessions of fewer than `least` events (before the cap) go. Rows without a thread or a node are left out.
    """
    iteration = F.coalesce(F.col("threadIteration").try_cast("long"), F.col("grpThreads").try_cast("long"), F.lit(-1))
    known = rows.where("trim(threadName) <> '' and n is not null").select(group_key(F.trim("threadName"), iteration).alias("g"), "seq", "n")
    whole = known.withColumn("_k", F.row_number().over(Window.partitionBy("g").orderBy("seq"))).withColumn("_all", F.count("*").over(Window.partitionBy("g")))
    return whole.where((F.col("_all") >= least) & (F.lit(cap == 0) | (F.col("_k") <= cap))).select("g", "seq", "n")
