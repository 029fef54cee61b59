"""Streams of departures: the same aggregates on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def innovation_windows(departures: DataFrame, *, window: str = "1 hour", late: str = "2 hours", large: float = 10.0) -> DataFrame:
    """Count, mean, spread and share of large departures for each time window; departures: ts, d.
    On a stream, rows later than ``late`` are dropped, as the window's state is then gone."""
    rows = departures.withWatermark("ts", late) if departures.isStreaming else departures
    big = F.abs("d") > large
    return rows.groupBy(F.window("ts", window).alias("window")).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.avg(big.cast("double")).alias("large_share"))
