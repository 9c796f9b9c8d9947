"""Joins on keys of which a few hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key with more than this share of all rows is hot; there are fewer than 1000 of them, whatever the data.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, counted: DataFrame, on: str, total: int, count: str = "n") -> DataFrame:
    """Inner join of rows with counted, which has one row for each key and in `count` how many of the `total` rows have it.

    Hot keys, fewer than HOT_SHARE, are broadcast and their rows stay where they are; the others meet by a shuffle in which no key is large.
    rows and counted are read twice, so they should be tables. `count` doesn't come back. A null key joins nothing.
    """
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    hot = F.broadcast(counted.where(is_hot).drop(count))
    light = rows.join(hot.select(on), on, "left_anti").join(counted.where(~is_hot).drop(count), on)
    return rows.join(hot, on).unionByName(light)
