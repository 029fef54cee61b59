"""Verification of fields and departures: profiles, projections, histograms and the like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics, stats
from ..schema import POINT, VARIABLES


def means(state: DataFrame) -> DataFrame:
    """Mean and spread of every variable at every point."""
    return state.groupBy(*POINT).agg(*(a for x in VARIABLES for a in (F.avg(x).alias(x), F.stddev_samp(x).alias(f"s_{x}"))))


def by_variable(state: DataFrame, truth: DataFrame) -> DataFrame:
    """i, j, k, var, mean, spread, truth: one row for each point and variable."""
    t = truth.select(*POINT, *(F.col(x).alias(f"t_{x}") for x in VARIABLES))
    each = F.array(*(F.struct(F.lit(x).alias("var"), F.col(x).alias("mean"), F.col(f"s_{x}").alias("spread"), F.col(f"t_{x}").alias("truth")) for x in VARIABLES))
    return means(state).join(t, list(POINT)).select(*POINT, F.explode(each).alias("e")).select(*POINT, "e.*")


def global_metrics(rows: DataFrame) -> DataFrame:
    """Error, bias and spread for each variable."""
    e = F.col("mean") - F.col("truth")
    return rows.groupBy("var").agg(stats.rmse(e).alias("rmse"), F.avg(e).alias("bias"), F.avg("spread").alias("spread"))


def point_metrics(rows: DataFrame) -> DataFrame:
    """Error, bias and spread of each point over all variables, in mixed units."""
    e = F.col("mean") - F.col("truth")
    return rows.groupBy(*POINT).agg(stats.rmse(e).alias("rmse"), F.avg(e).alias("bias"), F.avg("spread").alias("spread"))


def profiles(rows: DataFrame) -> DataFrame:
    """Error and mean spread for each level and variable."""
    return rows.groupBy("var", "k").agg(stats.rmse(F.col("mean") - F.col("truth")).alias("rmse"), F.avg("spread").alias("spread"))


def of_mean(state: DataFrame) -> DataFrame:
    """Reflectivity of the mean state and mean reflectivity of the states, at each point."""
    both = state.withColumn("y", physics.h()).groupBy(*POINT).agg(*(F.avg(x).alias(x) for x in VARIABLES), F.avg("y").alias("mean_of_h"))
    return both.select(*POINT, physics.h().alias("h_of_mean"), "mean_of_h")


def projections(field: DataFrame, value: str) -> DataFrame:
    """Greatest value along each axis: axis, a, b (the two indices left), most. Values that are no number are passed over."""
    along = F.array(*(F.struct(F.lit(x).alias("axis"), F.col(a).alias("a"), F.col(b).alias("b")) for x, a, b in (("z", "i", "j"), ("y", "i", "k"), ("x", "j", "k"))))
    return field.select(F.explode(along).alias("e"), stats.finite(F.col(value)).alias("v")).groupBy("e.axis", "e.a", "e.b").agg(F.max("v").alias("most"))


def effective_size(departures: DataFrame, r: float) -> DataFrame:
    """Effective ensemble size of each observation under the likelihood. departures: obs_id, d of each member."""
    w = departures.withColumn("w", physics.likelihood(F.col("d"), F.lit(r)))
    sums = w.groupBy("obs_id").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("s2"))
    return sums.select("obs_id", (F.pow(F.col("s") + 1e-12, F.lit(2.0)) / F.col("s2")).alias("ess"))


def histogram(values: DataFrame, x: Column, lo: float, hi: float, bins: int, *keys: str, density: bool = False) -> DataFrame:
    """Count (and density) of each bin that has values."""
    out = values.withColumn("bin", stats.bin_of(x, lo, hi, bins)).where("bin is not null").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    if density:
        over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        out = out.withColumn("density", F.col("n") / (F.sum("n").over(over) * ((hi - lo) / bins)))
    return out


def innovations(departures: DataFrame, *keys: str, large: float = 10.0) -> DataFrame:
    big = F.abs("d") > large
    return departures.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.min("d").alias("least"), F.max("d").alias("most"), F.median("d").alias("median"), F.count_if(big).alias("n_large"), F.avg(big.cast("double")).alias("large_share"))


def hexbin(points: DataFrame, x: str, y: str, gridsize: int, extent: tuple[float, float, float, float]) -> DataFrame:
    x0, x1, y0, y1 = extent
    cx, cy = stats.hexagon(F.col(x), F.col(y), gridsize, extent)
    inside = points.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    return inside.groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count(F.lit(1)).alias("n"))


def tight_box(field: DataFrame, a: str, b: str, value: str, *, threshold: float = 0.0, pad: int = 2) -> DataFrame:
    """Index limits of where value is above threshold, padded, clipped and with half-cell edges; all of the field if nowhere."""
    here = F.col(value) > threshold
    ends = [(f(F.when(here, F.col(c))), g(c), sign) for c in (a, b) for f, g, sign in ((F.min, F.min, -1), (F.max, F.max, 1))]
    limit = lambda low, full, sign: F.coalesce((F.greatest if sign < 0 else F.least)(low + sign * pad, full), full) + sign * 0.5
    names = ("a_min", "a_max", "b_min", "b_max")
    parts = field.agg(*(x.alias(f"{n}_{t}") for (low, full, _), n in zip(ends, names, strict=True) for x, t in ((low, "in"), (full, "all"))))
    return parts.select(*(F.when(F.col(f"{n}_in").isNull(), F.col(f"{n}_all") + s * 0.5).otherwise(limit(F.col(f"{n}_in"), F.col(f"{n}_all"), s)).alias(n) for n, (_, _, s) in zip(names, ends, strict=True)))


def conditional(rows: DataFrame, threshold: float) -> DataFrame:
    """Error of each variable where the truth is above the threshold, and the number of points."""
    test = F.col("truth") > threshold
    return rows.groupBy("var").agg(stats.conditional_rmse(F.col("mean") - F.col("truth"), test).alias("rmse"), F.count_if(test).alias("n"))


def change(rmse: Column, base: Column) -> Column:
    """Percent change of an error against a baseline's; null where that is 0."""
    return (rmse - base) * 100.0 / F.nullif(base, F.lit(0.0))


def change_of_rmse(errors: DataFrame, baseline: str) -> DataFrame:
    """Percent change of each method's error against the baseline's. errors: var, method, rmse."""
    base = errors.where(F.col("method") == baseline).select("var", F.col("rmse").alias("base"))
    return errors.join(base, "var").select("var", "method", change(F.col("rmse"), F.col("base")).alias("change"))
