"""Shards in order of an identifier, the same on every run and cluster.

A shard is a task's range of identifiers; writers roll files within it. So the
number of shards, and with it what the driver holds, has a bound, and shards of
a very large table are larger instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A small table gets up to so many shards, of SMALLEST bytes at least; a large one shards of LARGEST bytes.
SHARDS, SMALLEST, LARGEST = 64, 1 << 18, 256 << 20
#: Shards at most.
MOST_SHARDS = 1 << 14
#: Sampled identifiers for a shard; more make shards more even.
PER_SHARD = 64
LOWEST = -(2**63)


def ordered_id(name: str) -> Column:
    """The identifier as a long, null below all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LOWEST))


def shard_bounds(df: DataFrame, ident: str, size: Column, *, shards: int = SHARDS, smallest: int = SMALLEST, largest: int = LARGEST) -> np.ndarray:
    """The least identifier of every shard but the first; PER_SHARD sampled identifiers for each go to the driver. Identifiers are sampled by their
    hash, so the bounds depend on the rows alone, not on how they are dealt to tasks."""
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    n = min(MOST_SHARDS, max(1, min(shards, total // smallest), -(-total // largest)))
    if n == 1:
        return np.zeros(0, np.int64)
    every = max(1, rows // (n * PER_SHARD))
    ids = ordered_id(ident)
    some = df.select(ids.alias("i")).where(F.pmod(F.xxhash64("i"), F.lit(every)) == 0)
    at = np.sort(np.array([r.i for r in some.toLocalIterator()], np.int64))
    return np.unique(at[(np.arange(1, n) * len(at)) // n]) if len(at) else np.zeros(0, np.int64)


def shard_of(bounds: np.ndarray):
    """A column function: the shard of an ordered identifier. bounds: one long for a shard."""

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32))

    return shard


def in_shards(df: DataFrame, bounds: np.ndarray, ident: str, *order: str) -> DataFrame:
    """df with the column shard, each shard in one task and sorted by the identifier and order."""
    n = len(bounds) + 1
    return df.withColumn("shard", shard_of(bounds)(F.col(ident))).repartitionById(n, "shard").sortWithinPartitions("shard", ident, *order)
