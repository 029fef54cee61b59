"""Connected components of a graph of links, by alternating large and small stars.

Every step is an aggregation with partial minima and a join on its key; nothing
is gathered for a node. Links are folded to stars within tasks first, which saves
rounds. Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links that a task holds while it folds them.
FOREST = 1_000_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _folded(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as stars: each node with the smallest one it is linked to here."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)  # the root of the larger side is linked as well
        while True:
            short = new[new]
            if (short == new).all():
                break
            new = short
        if (new == label).all():
            break
        label = new
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars, for up to FOREST links at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        stars = _folded(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars], ["u", "v"])

    for b in batches:
        held.append((b.column("u").to_numpy(), b.column("v").to_numpy()))
        if sum(len(u) for u, _ in held) >= FOREST:
            yield flush()
    if held:
        yield flush()


def connected(links: DataFrame) -> DataFrame:
    """links: long columns a, b. Returns v, root: every linked node and the smallest node of its component."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.stored(edges.mapInArrow(_forest, "u long, v long"), "components")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: larger neighbours move to the least of the neighbourhood.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours and the node itself move to the least smaller one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, common.stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "components")
        common.release(old)
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(edges.select("v", F.col("v").alias("root")).distinct())
