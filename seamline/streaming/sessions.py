"""The temporal path as a stream: pairs of nodes seen together in event-time windows, with late and repeated events handled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seamline.operators.sessions import _split

EPOCH = pd.Timestamp(0)


def windowed_cooccurrence(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, g, nodes: the distinct nodes of each group in each window of event time. events: id, ts (timestamp), g, n; an id that comes again within the watermark counts once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy(F.window("ts", window), "g").agg(F.array_sort(F.collect_set("n")).alias("nodes")).select(F.col("window.start").alias("start"), "g", "nodes")


def pairs(sets: DataFrame) -> DataFrame:
    """i, j: each pair of nodes of a set, i < j."""
    a = sets.select("start", "g", F.explode("nodes").alias("i"), "nodes")
    return a.select("start", "g", "i", F.explode(F.filter("nodes", lambda n: n > F.col("i"))).alias("j"))


def anchored_sessions(events: DataFrame, cap_ms: int, late: str = "10 minutes") -> DataFrame:
    """g, seq, t, n, session of a stream: what the batch operator (operators.sessions.anchored_sessions) gives for the same events, in append mode.

    events: g (string), seq (long, rising with the time of a group's events), ts (timestamp), n (string). An event waits in its group's state until the watermark, `late` behind the newest event, has passed it; then it is numbered
    in order of time and seq, with the open session's first time and number from the state. Events behind the watermark are dropped, and so are those without a time. A group whose events have
    all been numbered keeps three numbers, so that it goes on where it stood, also after a restart from the checkpoint.
    """
    rows = events.where("ts is not null").select("g", "seq", "ts", "n").withWatermark("ts", late)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, session, seqs, times, names = state.get if state.exists else (-1, 0, [], [], [])
        parts = [pd.DataFrame({"seq": list(seqs), "t": list(times), "n": list(names)})]
        if not state.hasTimedOut:
            parts += [pd.DataFrame({"seq": b["seq"], "t": (b["ts"] - EPOCH) // pd.Timedelta(milliseconds=1), "n": b["n"]}) for b in batches]
        waiting = pd.concat([p for p in parts if len(p)] or parts[:1]).sort_values(["t", "seq"], kind="stable")
        passed = state.getCurrentWatermarkMs()
        ready, rest = waiting[waiting["t"] < passed], waiting[waiting["t"] >= passed]
        number = np.empty(len(ready), np.int64)
        if len(ready):
            first, session = _split(ready["t"].to_numpy(np.int64), number, None if anchor < 0 else anchor, session, cap_ms)
            anchor = -1 if first is None else first
        state.update((int(anchor), int(session), [int(x) for x in rest["seq"]], [int(x) for x in rest["t"]], [str(x) if x is not None else None for x in rest["n"]]))
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest["t"].min()), passed + 1))
        yield pd.DataFrame({"g": key[0], "seq": ready["seq"].astype("int64"), "t": ready["t"].astype("int64"), "n": ready["n"], "session": number})

    kept = "anchor long, session long, seqs array<long>, times array<long>, names array<string>"
    return rows.groupBy("g").applyInPandasWithState(run, "g string, seq long, t long, n string, session long", kept, "append", GroupStateTimeout.EventTimeTimeout)
