"""Deterministic samples: hashes of ids in place of a random state, so they hold in any order and on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


#: Bits of a hash that orders rows, and how many rows of equal leading bits are sorted by one task.
HASH_BITS, SORTED = 53, 1 << 16


def uniform(*keys: str | Column, seed: int = 42) -> Column:
    """A number in [0, 1) from the keys and the seed."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def hashed(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The distinct keys with their hashes and the hash range of each, for several calls of drop_exact as a table."""
    return df.select(key).distinct().withColumn("_u", uniform(F.col(key), seed=seed)).withColumn("_b", F.floor(F.col("_u") * 4096))


def drop_exact(df: DataFrame, key: str, rate: float, seed: int = 42, keys: DataFrame | None = None) -> DataFrame:
    """Rows of exactly round((1 - rate) * n) of the n distinct keys, half to even; the keys with the least hashes. keys: what `hashed` makes of df.

    The nth hash is found by counts of hash ranges, then within one range, so no task sorts all keys; rows are then told by their own hashes, and join nothing.
    """
    keys = hashed(df, key, seed) if keys is None else keys
    bins = keys.groupBy("_b").agg(F.count("*").alias("c")).orderBy("_b").collect()  # at most 4096 rows
    left, below = round((1 - rate) * sum(r["c"] for r in bins)), 0
    cut = None
    for r in bins:
        if r["c"] > left:
            cut, below = r["_b"], r["_b"]
            break
        left, below = left - r["c"], r["_b"] + 1
    u = uniform(F.col(key), seed=seed)
    keep = F.floor(u * 4096) < below
    if cut is not None and left:
        last = keys.where(F.col("_b") == cut).orderBy("_u", key).limit(left).agg(F.max(F.struct("_u", key)).alias("last"))  # one row
        within = F.struct(u.alias("_u"), F.col(key)) <= F.col("last")
        return df.crossJoin(F.broadcast(last)).where(F.col(key).isNotNull() & (keep | ((F.floor(u * 4096) == cut) & within))).select(*df.columns)
    return df.where(F.col(key).isNotNull() & keep)


def drop_items(df: DataFrame, keys: list[str], rate: float, seed: int = 42) -> DataFrame:
    """Rows kept with probability 1 - rate each, by their keys."""
    return df.where(uniform(*keys, seed=seed) >= rate)


def shuffled(sim: DataFrame, seed: int = 42) -> DataFrame:
    """The values of a matrix dealt out anew among its pairs, by matching two hash orders range by range."""
    n = 1024
    a = sim.select("i", "j", F.floor(uniform("i", "j", seed=seed) * n).alias("_b"), uniform("i", "j", seed=seed + 1).alias("_o"))
    return _matched(a, sim.select("v", F.floor(uniform("i", "j", seed=seed) * n).alias("_b"), uniform("i", "j", seed=seed + 2).alias("_o")))


def _matched(places: DataFrame, values: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("_b").orderBy("_o"))
    return places.withColumn("_k", nth).join(values.withColumn("_k", nth).drop("_o"), ["_b", "_k"]).select("i", "j", "v")


def least_hashed(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """The n rows with the least hashes of their keys, then by the keys; all rows if there are fewer.

    The nth hash is found by counts of hash ranges, each time within the range that holds it, so no task sorts all rows. Rows with equal keys are told apart by nothing: any of them may be taken.
    """
    if n <= 0:
        return df.limit(0)
    rows = df.withColumn("_h", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << HASH_BITS)))
    low, bits, left = 0, HASH_BITS, n  # the nth hash is in [low, low + 2^bits), where `left` rows are wanted
    while bits > 0:
        step = max(0, bits - 12)
        inside = rows.where((F.col("_h") >= low) & (F.col("_h") < low + (1 << bits)))
        bins = inside.groupBy(F.shiftright(F.col("_h") - low, step).alias("b")).agg(F.count("*").alias("c")).orderBy("b").collect()  # at most 4096 rows
        if sum(r["c"] for r in bins) <= left:
            low, left = low + (1 << bits), 0
            break
        for r in bins:
            if r["c"] > left:
                low, bits = low + (r["b"] << step), step
                break
            left -= r["c"]
        if not left or r["c"] <= SORTED:
            break
    whole = rows.where(F.col("_h") < low)
    if left:
        whole = whole.union(rows.where((F.col("_h") >= low) & (F.col("_h") < low + (1 << bits))).orderBy("_h", *keys).limit(left))
    return whole.drop("_h")


def balanced_pairs(pairs: DataFrame, hard_share: float = 0.3, ratio: float = 2.0, seed: int = 42) -> DataFrame:
    """All positive pairs (y = 1) and a sample of the negative ones: hard ones (static >= 0.6, temp <= 0.3) up to a share of the positives, others up to `ratio` times them in all."""
    n = pairs.agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if((F.col("y") == 0) & (F.col("static") >= 0.6) & (F.col("temp") <= 0.3)).alias("hard")).first()
    hard_n = min(n["hard"], int(n["pos"] * hard_share))
    is_hard = (F.col("static") >= 0.6) & (F.col("temp") <= 0.3)
    neg = pairs.where("y = 0")
    hard = least_hashed(neg.where(is_hard), hard_n, "i", "j", seed=seed)
    plain = least_hashed(neg.where(~is_hard), max(0, int(n["pos"] * ratio) - hard_n), "i", "j", seed=seed)
    return pairs.where("y = 1").union(hard).union(plain)


def capped(df: DataFrame, cap: int, *keys: str, seed: int = 42) -> DataFrame:
    """At most `cap` rows, those with the least hashes of their keys (which tell rows apart)."""
    return least_hashed(df, cap, *keys, seed=seed)
