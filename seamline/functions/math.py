"""Column functions on similarities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def damp_exp(s: Column, u: Column, k: float | Column) -> Column:
    return s * F.exp(-k * u)


def damp_gate(s: Column, u: Column, median: Column, power: float = 1.0) -> Column:
    """The share of certainty, to a power where the uncertainty is at least the median."""
    return F.when(u >= median, s * F.pow(1 - u, F.lit(power))).otherwise(s * (1 - u))


def damp_sigmoid(s: Column, u: Column, alpha: float, beta: Column) -> Column:
    return s * (1 - sigmoid(alpha * (u - beta)))


def package_distance(a: Column, b: Column) -> Column:
    """Steps between two dotted paths through their longest common beginning."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    common = F.aggregate(F.arrays_zip(x.alias("x"), y.alias("y")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, z: F.struct(
        (s["n"] + (s["on"] & F.coalesce(z["x"] == z["y"], F.lit(False))).cast("int")).alias("n"), (s["on"] & F.coalesce(z["x"] == z["y"], F.lit(False))).alias("on")), lambda s: s["n"])
    return F.size(x) + F.size(y) - 2 * common


def improvement(new: Column, base: Column, higher_is_better: bool) -> Column:
    """Percent by which new is better than base; null for a base of zero."""
    gain = (new - base) if higher_is_better else (base - new)
    return F.when(base != 0, gain / F.abs(base) * 100)


def service_closeness(services: Column, low: int, high: int) -> Column:
    """1 in the middle of the wanted range of service counts, 0 at its ends and beyond; 0 for none."""
    radius = max(1.0, (high - low) / 2)
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(services - (low + high) / 2) / radius), F.lit(0.0))


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def pair_scores(base: Column, new: Column, default: float = 0.0) -> Column:
    """base, new scaled between the two of them: 0 and 1, or both 0.5 where they are equal or alone; `default` for one that is missing."""
    b, n = _finite(base.cast("double")), _finite(new.cast("double"))
    low, high = F.least(b, n), F.greatest(b, n)
    score = lambda x: F.when(low.isNull(), F.lit(default)).when(high <= low, F.lit(0.5)).otherwise(F.coalesce((x - low) / (high - low), F.lit(default)))
    return F.struct(score(b).alias("base"), score(n).alias("new"))


def relative_gain(base: Column, new: Column, most: float = 2.0, missing: float = 0.75) -> Column:
    """The gain over the base's size, cut to +-most and mapped to 0 .. 1; `missing` without a base, 0 without a new value."""
    b, n = _finite(base.cast("double")), _finite(new.cast("double"))
    gain = clip((n - b) / (F.abs(b) + 1e-9), -most, most)
    return F.when(n.isNull(), F.lit(0.0)).when(b.isNull(), F.lit(clip_number(missing))).otherwise((gain + most) / (2 * most))


def clip_number(x: float) -> float:
    return max(0.0, min(1.0, x))
