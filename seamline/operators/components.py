"""Connected components of a distributed set of links, by contraction.

Each level joins nodes that links hold together and goes on with the links between the nodes so joined; the links stay in tables, never on the driver.
Only their number comes back between levels. Once there are LIGHT links or fewer, one task ends the work.
Of a graph with many links a node, a level first takes some four links a node and joins their components, and looks at all other links once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.operators.skew import join_counted
from seamline.workspace import Workspace

LINKS = "a long, b long"
#: Links, two numbers each, that one task may well hold: 16 MB.
LIGHT = 1 << 20
#: Links a node (counted once as the greater and once as the lesser end) from which on a level takes the components of a few links of each node.
DENSE = 4


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as join the same nodes: each node with the least of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of all links of the batches, which are few."""
    held = [(np.asarray(b.column(0)).astype(np.int64), np.asarray(b.column(1)).astype(np.int64)) for b in batches]
    if held:
        a, b = forest(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _roots(up: DataFrame, work: Workspace, name: str) -> DataFrame:
    """a, b: each node u of up (u, m < u, one row a node) with the last node that the steps from u to m end at. Every round doubles the steps that a row takes.

    A node that many others step to is a hot key, and is joined as one.
    """
    total, step = up.count(), 0
    while True:
        ahead = up.groupBy("m").agg(F.count("*").alias("n")).join(up.select(F.col("u").alias("m"), F.col("m").alias("next")), "m", "left")
        ahead = work.keep(ahead, f"{name}ahead{step}")
        if not ahead.where("next is not null").limit(1).collect():
            return up.select(F.col("u").alias("a"), F.col("m").alias("b"))
        step += 1
        up = work.keep(join_counted(up, ahead.select("m", F.coalesce("next", "m").alias("next"), "n"), "m", total).select("u", F.col("next").alias("m")), f"{name}up{step}")
        work.drop(f"{name}ahead{step - 1}", *([f"{name}up{step - 1}"] if step > 1 else []))


def _components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """a, b: each node with the least of its component, unless it is the least itself. links (a > b) are a table.

    Few links a node: each node joins its least neighbour, if that is smaller; of two levels one at least joins each node to another.
    Many: the components of the links to its least and its greatest neighbours of either kind join each node.
    Then both ends of all links get the labels they have so far, and links between two labels are a graph with fewer nodes.
    """
    n = links.count()
    if n <= LIGHT:
        return work.keep(links.coalesce(1).mapInArrow(_finished, LINKS), f"{name}stars")
    ends = {x: work.keep(links.groupBy(F.col(x).alias("u")).agg(F.min(y).alias("m"), F.max(y).alias("o"), F.count("*").alias("n")), name + x) for x, y in (("a", "b"), ("b", "a"))}
    if DENSE * (ends["a"].count() + ends["b"].count()) > n:
        stars = _roots(ends["a"].select("u", "m"), work, name)
    else:
        some = ends["a"].select(F.col("u").alias("a"), F.explode(F.array("m", "o")).alias("b")).union(ends["b"].select(F.explode(F.array("m", "o")), "u"))
        stars = _components(work.keep(some.distinct(), f"{name}some"), work, f"{name}some-")
    stars = work.keep(stars, f"{name}joined")
    labels = stars.select(F.col("a").alias("u"), F.col("b").alias("label"))
    of = lambda x: work.keep(ends[x].join(labels, "u", "left").select(F.col("u").alias(x), F.coalesce("label", "u").alias(f"l{x}"), "n"), f"{name}l{x}")
    half = work.keep(join_counted(links, of("a"), "a", n).select("la", "b").distinct(), f"{name}half")
    met = join_counted(half, of("b"), "b", n).where("la <> lb")  # no node has more rows in half than in links
    rest = work.keep(met.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct(), f"{name}rest")
    work.drop(*(name + x for x in ("a", "b", "la", "lb", "half")))
    if not rest.limit(1).collect():
        return stars
    roots = _components(rest, work, f"{name}rest-")
    again = stars.join(roots.select(F.col("a").alias("b"), F.col("b").alias("root")), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
    return work.keep(again.union(roots), f"{name}all")


def connected_components(links: DataFrame, contracted: bool = False) -> DataFrame:
    """node, label (the least node of its component) for every node of links (a, b: long) that isn't the least itself.

    Null ends and links of a node with itself are ignored; repeated links and either direction count once. No links: no rows.
    contracted: the links come as forests already, so that few are left once they are distinct.
    """
    work = Workspace(links.sparkSession, "components")
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    found = _components(work.keep(pairs.distinct() if contracted else pairs, "links"), work, "")
    return found.select(F.col("a").alias("node"), F.col("b").alias("label"))
