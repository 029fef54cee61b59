"""Statistics of departures that add up: parts of a table or of a stream are summed, and sums of parts are merged.

A row of sums holds one bin of one group; sums of any split of the rows merge to those of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

SUMS = ("n", "s", "s2", "n_large")


def summed(rows: DataFrame, departure: Column, *keys: str, low: float = -20.0, high: float = 20.0, bins: int = 40, large: float = 10.0) -> DataFrame:
    """keys, bin (null outside low to high), n, s and s2 (sums of the departure and its square), least, most, n_large.
    Departures that are null or no number don't count."""
    d = rows.withColumn("d", stats.finite(departure)).where("d is not null").withColumn("bin", stats.bin_of(F.col("d"), low, high, bins))
    return d.groupBy(*keys, "bin").agg(F.count("d").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("s2"), F.min("d").alias("least"), F.max("d").alias("most"), F.count_if(F.abs("d") > large).alias("n_large"))


def merged(sums: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``summed`` with the same keys and bin as one."""
    return sums.groupBy(*keys, "bin").agg(*(F.sum(c).alias(c) for c in SUMS), F.min("least").alias("least"), F.max("most").alias("most"))


def statistics(sums: DataFrame, *keys: str) -> DataFrame:
    """Count, mean, spread, range and share of large departures of each group."""
    total = sums.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in SUMS), F.min("least").alias("least"), F.max("most").alias("most"))
    mean = F.col("s") / F.col("n")
    return total.select(*keys, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), "least", "most", "n_large", (F.col("n_large") / F.col("n")).alias("large_share"))


def histogram(sums: DataFrame, *keys: str) -> DataFrame:
    """Count of each bin that has departures."""
    return sums.where("bin is not null").groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
