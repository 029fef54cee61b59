"""Slices, masks and small reshapes of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats

#: Codes of quality-control settings in the names of results.
QC_CODES = {(False, False, "and"): "none", (True, False, "and"): "E", (False, True, "and"): "T", (True, True, "and"): "ET_and", (True, True, "or"): "ET_or"}


def qc_code(filter_ensemble: bool, filter_truth: bool, mode: str = "and") -> str:
    both = filter_ensemble and filter_truth
    return QC_CODES[filter_ensemble, filter_truth, mode.lower() if both else "and"]


def plane(field: DataFrame, **at: int) -> DataFrame:
    """Points of a plane (or line) with the given indices."""
    for axis, value in at.items():
        field = field.where(F.col(axis) == value)
    return field.drop(*at)


def masked_below(value: Column, least: float) -> Column:
    return F.when(value >= least, value)


def without_zero(value: Column) -> Column:
    return F.nullif(value, F.lit(0.0))


def scaled(field: DataFrame, factors: dict[str, float]) -> DataFrame:
    return field.withColumns({c: F.col(c) * f for c, f in factors.items()})


def nth_level(field: DataFrame, z: str, n: int) -> DataFrame:
    """Rows of the n-th (from 0) distinct height."""
    heights = field.select(z).distinct().withColumn("__n", F.row_number().over(Window.orderBy(z)) - 1).where(F.col("__n") == n)
    return field.join(F.broadcast(heights.select(z)), z, "left_semi")


def column_profile(state: DataFrame, truth: DataFrame, value: str, i: int, j: int) -> DataFrame:
    """Mean, standard deviation and range over members, and the truth, for each level of a column."""
    own = plane(state, i=i, j=j).groupBy("k").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    return own.join(plane(truth, i=i, j=j).select("k", F.col(value).alias("truth")), "k")


def range_histogram(values: DataFrame, value: str, bins: int, *keys: str) -> DataFrame:
    """Count of each of a number of bins over each group's range; a group with one value has it in bin 0."""
    x = F.col(value)
    ends = values.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    rows = values.where(x.isNotNull()).join(F.broadcast(ends), list(keys)) if keys else values.where(x.isNotNull()).crossJoin(F.broadcast(ends))
    at = F.floor((x - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int")
    return rows.groupBy(*keys, F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pivoted(rows: DataFrame, keys: list[str], by: str, values: list, value: str) -> DataFrame:
    """One column for each of the values of by; rows that compare experiments side by side."""
    return rows.groupBy(*keys).pivot(by, values).agg(F.first(value))


def skipping(value: str) -> dict[str, Column]:
    """Mean and greatest of what is a number."""
    x = stats.finite(F.col(value))
    return {"mean": F.avg(x), "most": F.max(x), "n": F.count(x)}
