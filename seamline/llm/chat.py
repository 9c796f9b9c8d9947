"""Conversations as training windows, with DataFrame functions only.

Turns are written between tags. Prefix sums of turn tokens choose turn-aligned spans of new turns, of which two are joined where the budget takes both; a window is the system turn, the end of the span before
as history, and the new turns. Assistant texts are under the loss mask where they are new, so each counts once.

Text and role have &, < and > as entities, so a tag never stands inside one, and unescaping gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<turn ", "</turn>\n"


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 256, bytes_a_token: int = 4) -> DataFrame:
    """conv_id, window (from 0), text, n_turns, n_repeated (leading turns that an earlier window has), loss (array of start, length in text), tokens.

    turns: conv_id, turn, role, text. A turn's tokens are its written bytes over bytes_a_token, rounded up. A window holds at most `budget` of them unless one turn
    is longer than what the system turn and the history leave; such a turn is the only new one of its window. The history is made of whole turns
    of the span before, at most `history` tokens. The system turn is a first turn with role system; it stands first in every window.

    Null text and role are empty. Equal turn numbers are ordered by role, then text (nulls first); a null number comes first; repeated rows are turns of their own.
    Null conv_ids are one conversation. A very long conversation is sorted and summed by one task, which spills. Empty input: no rows. Other columns are ignored.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("nth", F.row_number().over(order))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(">"))
    t = t.select("conv_id", "nth", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    t = t.withColumn("tokens", F.ceil((F.octet_length("head") + F.octet_length("body") + len(CLOSE)) / bytes_a_token).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("nth")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("is_system", (F.col("nth") == 1) & (F.col("role") == "system"))
    t = t.withColumn("system_tokens", F.max(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(whole))
    # Half of what is left for new turns: turns whose sums end in the same half step then need at most the whole.
    t = t.withColumn("half", F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("system_tokens")) / 2)))
    t = t.withColumn("sum", F.sum(F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))).over(order))
    t = t.withColumn("step", F.floor((F.col("sum") - 1) / F.col("half"))).withColumn("long", ~F.col("is_system") & (F.col("tokens") > F.col("half")))
    before = F.lag("is_system").over(order)
    starts = ~F.col("is_system") & ~F.coalesce(before, F.lit(True)) & ((F.col("step") != F.lag("step").over(order)) | F.col("long") | F.lag("long").over(order))
    # Two neighbouring steps that fit together are one window.
    t = t.withColumn("starts", starts).withColumn("part", F.sum(F.col("starts").cast("int")).over(order)).withColumn("pair", F.floor(F.col("part") / 2))
    both = F.sum(F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))).over(Window.partitionBy("conv_id", "pair"))
    joined = (F.col("part") % 2 == 1) & (both <= F.lit(budget - history) - F.col("system_tokens"))
    t = t.withColumn("starts", (F.col("starts") & ~joined).cast("int")).withColumn("window", F.sum("starts").over(order)).withColumn("windows", F.sum("starts").over(whole) + 1)
    span = Window.partitionBy("conv_id", "window")
    t = t.withColumn("tail", F.max("sum").over(span) - F.col("sum") + F.col("tokens"))
    again = ~F.col("is_system") & (F.col("tail") <= history) & (F.col("window") + 1 < F.col("windows"))
    places = F.when(F.col("is_system"), F.sequence(F.lit(0), F.col("windows") - 1)).when(again, F.array("window", F.col("window") + 1)).otherwise(F.array("window"))
    rows = t.withColumn("own", F.col("window")).withColumn("window", F.explode(places)).withColumn("fresh", F.col("own") == F.col("window"))
    rows = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("nth", "fresh", "role", "head", "body", "tokens"))).alias("t"))
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)
    spans = F.aggregate(
        "t", F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.when(x["fresh"] & (x["role"] == "assistant"), F.array_append(a["loss"], F.struct((a["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length")))).otherwise(a["loss"]).alias("loss")),
        lambda a: a["loss"],
    )
    text = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    return rows.select("conv_id", "window", text.alias("text"), F.size("t").alias("n_turns"), F.size(F.filter("t", lambda x: ~x["fresh"])).alias("n_repeated"), spans.alias("loss"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"))


def _parsed(part: Column) -> Column:
    end = F.instr(part, ">")
    return F.struct(unescape(F.substr(part, F.lit(len(OPEN) + 1), end - len(OPEN) - 1)).alias("role"), unescape(F.substr(part, end + 1)).alias("text"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss (the texts under the mask, in order), formatted_chars: parsed from what chat_windows() wrote."""
    # Repeated turns come first in a window; the part after the last tag is empty.
    parts = F.slice(F.split("text", F.lit(CLOSE), -1), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    masked = F.transform("loss", lambda x: unescape(F.substr(F.col("text"), x["start"], x["length"])))
    each = windows.select("conv_id", "window", F.transform(parts, _parsed).alias("turns"), masked.alias("loss"), F.length("text").cast("long").alias("chars"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.flatten(F.transform("w", lambda x: x["loss"])).alias("loss"), "formatted_chars")
