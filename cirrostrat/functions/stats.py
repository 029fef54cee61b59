"""Verification aggregates and bins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, null where it is not a number: aggregates pass over it."""
    return F.nanvl(x, F.lit(None).cast("double"))


def rmse(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


def weighted(value: Column, weight: Column) -> Column:
    """Weighted mean; null without weight. Rows without value or weight don't count."""
    return F.sum(weight * value) / F.nullif(F.sum(F.when(value.isNotNull(), weight)), F.lit(0.0))


def weighted_rmse(error: Column, weight: Column) -> Column:
    return F.sqrt(weighted(error * error, weight))


def spread_rms(spread: Column) -> Column:
    return F.sqrt(F.avg(spread * spread))


def conditional_rmse(error: Column, test: Column) -> Column:
    return F.sqrt(F.avg(F.when(test, error * error)))


def bin_of(x: Column, lo: float, hi: float, bins: int) -> Column:
    """The bin of x from 0; the last includes hi; null outside and for what is no number."""
    at = F.floor((x - lo) / ((hi - lo) / bins)).cast("int")
    return F.when((x >= lo) & (x <= hi) & ~F.isnan(x), F.least(at, F.lit(bins - 1)))


def hexagon(x: Column, y: Column, gridsize: int, extent: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Centre of the hexagon that holds (x, y): the nearer of the nearest points of two shifted lattices."""
    x0, x1, y0, y1 = extent
    nx, ny = gridsize, int(gridsize / 3**0.5)
    sx, sy = (x1 - x0) / nx, (y1 - y0) / ny
    a, b = (x - x0) / sx, (y - y0) / sy
    # rint: halves to even
    a1, b1, a2, b2 = F.rint(a), F.rint(b), F.floor(a).cast("double"), F.floor(b).cast("double")
    d1 = F.pow(a - a1, F.lit(2.0)) + F.pow(b - b1, F.lit(2.0)) * 3.0
    d2 = F.pow(a - a2 - 0.5, F.lit(2.0)) + F.pow(b - b2 - 0.5, F.lit(2.0)) * 3.0
    near = d1 < d2
    return F.when(near, a1).otherwise(a2 + 0.5) * sx + x0, F.when(near, b1).otherwise(b2 + 0.5) * sy + y0
