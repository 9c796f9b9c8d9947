"""Predicates on class names, and filters of tables by them. Application prefixes are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seamline.functions import words
from seamline.functions.text import library_prefix, package, simple_name
from seamline.operators import ranges


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    return any_of([F.contains(c, F.lit(p)) for p in parts])


def starts_with_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    return any_of([F.startswith(c, F.lit(p)) for p in prefixes])


def is_business(c: Column, own: tuple[str, ...] = ()) -> Column:
    """Of the application: by its own prefixes first, then not foreign by prefix or part."""
    low = F.lower(F.trim(c))
    return c.isNotNull() & (starts_with_any(F.trim(c), own) | ~(starts_with_any(low, words.FOREIGN_PREFIXES) | contains_any(low, words.FOREIGN_PARTS)))


def is_root_base(c: Column) -> Column:
    """A base class of everything, which ties unrelated classes together."""
    s = F.lower(simple_name(F.trim(c)))
    return F.coalesce((s == "entitybase") | s.startswith("base") | s.endswith("base") | s.startswith("abstract"), F.lit(False))


def is_platform(c: Column) -> Column:
    return contains_any(F.lower(c), ("java.", "sun."))


def is_entity_like(c: Column) -> Column:
    return F.lower(c).rlike(r"\.(entity|entities|jpa|domain|model|dto|vo|po)")


def is_noise_package(c: Column, extra: tuple[str, ...] = ()) -> Column:
    """Data holders and tools: by the caller's parts of packages, the fixed ones, then the simple name."""
    pkg, simple = F.lower(package(c)), F.lower(simple_name(c))
    return contains_any(pkg, extra) | contains_any(pkg, words.NOISE_PACKAGES) | simple.rlike("(dto|vo|po|entity|entities|model)$") | simple.rlike("exception|logger")


def is_stored_entity(c: Column) -> Column:
    """An entity of the storage layer, or a data object of the web layer."""
    return F.contains(c, F.lit(".jpa.")) | (F.contains(c, F.lit(".war.")) & simple_name(c).rlike("(Info|Item|Data|DTO|Model)$"))


def is_common_library(c: Column) -> Column:
    return library_prefix(c).isin(*words.LIBRARIES)


def candidates(names: DataFrame, semantic: DataFrame, base: str) -> DataFrame:
    """n: names (n) below the base package without parser residue; the semantic names (n) if none is left."""
    low = F.lower("n")
    good = names.where(F.startswith("n", F.lit(base)) & ~contains_any(low, (".em", ".q", ".tx", "util"))).select("n").distinct()
    any_ = good.limit(1).agg(F.count("*").alias("k"))
    return good.union(semantic.select("n").distinct().join(F.broadcast(any_)).where("k = 0").select("n"))  # one row


def covered(flags: DataFrame) -> DataFrame:
    """n, pos: names with text and a call or an import, by code point. flags: n, has_callgraph, has_dependency, has_semantic."""
    good = flags.where("has_semantic and (has_callgraph or has_dependency)").select("n").distinct()
    return ranges.ranked(good, [F.col("n")], "pos").withColumn("pos", F.col("pos").cast("int"))


def without_plumbing(names: DataFrame, mode: str = "substring") -> DataFrame:
    """names (n) without plumbing classes. raw: all stay; substring: a part anywhere; simple: a part of the simple name."""
    if mode == "raw":
        return names
    return names.where(~contains_any(F.lower("n") if mode == "substring" else F.lower(simple_name(F.col("n"))), words.PLUMBING))


def mapped(labels: DataFrame, rules: DataFrame) -> DataFrame:
    """labels (key, and others) with node for each class of their exact rule (key, nodes array); labels without a rule go."""
    return labels.join(rules.select("key", F.explode("nodes").alias("node")), "key")


def unreachable_rules(rules: DataFrame, normal) -> DataFrame:
    """Rules (key) that no label can meet, as the key isn't in its normal form, and keys that stand twice."""
    odd = rules.where(normal(F.col("key")) != F.col("key")).select("key", F.lit("not normal").alias("problem"))
    twice = rules.groupBy("key").count().where("count > 1").select("key", F.lit("duplicate").alias("problem"))
    return odd.union(twice)


def server_spans(spans: DataFrame) -> DataFrame:
    """Spans (kind) that a server made."""
    return spans.where("kind = 2")


#: Attributes that say what a span did.
TELLING = ("http.", "url.", "db.", "rpc.", "code.", "otel.", "net.", "server.", "client.")


def telling(attrs: Column, prefixes: tuple[str, ...] = TELLING) -> Column:
    """The entries of an attribute map whose keys start with one of the prefixes."""
    return F.map_filter(attrs, lambda k, _: starts_with_any(k, prefixes))


def without_attributes(spans: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """spans whose attrs lack the keys."""
    return spans.withColumn("attrs", F.map_filter("attrs", lambda k, _: ~k.isin(*keys)))


def labelled(rows: DataFrame, drop: str = "", part: str = "", prefix: str = "", only_success: bool = False) -> DataFrame:
    """Load-test rows by label: without those a pattern finds, with a part, with a prefix, successful ones only."""
    if drop:
        rows = rows.where(~F.coalesce(F.col("label"), F.lit("")).rlike(drop))
    if part:
        rows = rows.where(F.contains("label", F.lit(part)))
    if prefix:
        rows = rows.where(F.startswith("label", F.lit(prefix)))
    return rows.where(F.lower("success").isin("true", "1", "t", "yes")) if only_success else rows


def gated(labels: DataFrame, rules: DataFrame, normal) -> DataFrame:
    """labels (label, and others) with node for each class of the gate's rule (key, nodes): both sides in the gate's own normal form, so its rules are met whatever their spelling."""
    keyed = rules.select(normal(F.col("key")).alias("_key"), F.explode("nodes").alias("node")).distinct()
    return labels.withColumn("_key", normal(F.col("label"))).join(keyed, "_key").drop("_key")


def rule_hits(labels: DataFrame, rules: DataFrame, normal) -> DataFrame:
    """label, n, hit: each distinct label, how often it stands there, and whether a rule (key) maps it. labels: label."""
    keys = rules.select(F.col("key").alias("_key")).distinct().withColumn("hit", F.lit(True))
    counted = labels.groupBy("label").agg(F.count("*").alias("n")).withColumn("_key", normal(F.col("label")))
    return counted.join(keys, "_key", "left").select("label", "n", F.coalesce("hit", F.lit(False)).alias("hit"))
