"""Members, observation points and quality control."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics
from ..schema import POINT


def truth_of(state: DataFrame, truth: int) -> DataFrame:
    return state.where(F.col("m") == truth).drop("m")


def prior_of(state: DataFrame, truth: int, size: int | None = None) -> DataFrame:
    """Members other than the truth, the first ones by number. The list of members is as small as the ensemble."""
    members = [r.m for r in state.select("m").where(F.col("m") != truth).distinct().orderBy("m").collect()]
    if size is not None and size > len(members):
        raise ValueError(f"{size} prior members are asked for; there are {len(members)}")
    return state.where(F.col("m").isin(members[:size]))


def with_reflectivity(state: DataFrame) -> DataFrame:
    return state.withColumn("y", physics.h())


def on_stride(points: DataFrame, stride: int) -> DataFrame:
    return points.where((F.col("i") % stride == 0) & (F.col("j") % stride == 0))


def box(points: DataFrame, **ranges: tuple[int | None, int | None]) -> DataFrame:
    """Half-open index ranges i, j or k; negative ends count from the end of the axis."""
    negative = [a for a, ends in ranges.items() if any(e is not None and e < 0 for e in ends)]
    size = points.agg(*(F.max(a).alias(a) for a in negative)).first().asDict() if negative else {}
    for axis, ends in ranges.items():
        lo, hi = (e + (size[axis] or 0) + 1 if e is not None and e < 0 else e for e in ends)
        if lo is not None:
            points = points.where(F.col(axis) >= lo)
        if hi is not None:
            points = points.where(F.col(axis) < hi)
    return points


def observations(truth: DataFrame, prior: DataFrame, grid: DataFrame, *, stride: int = 1, r0: float = 5.0, noise: DataFrame | None = None, **qc) -> DataFrame:
    """Observation points: obs_id (in order of i, j, k), position, yo, yo_clean, r0. noise: i, j, k, noise."""
    most = with_reflectivity(prior).groupBy(*POINT).agg(F.max("y").alias("most"))
    points = on_stride(with_reflectivity(truth).select(*POINT, F.col("y").alias("yo_clean")), stride).join(most, list(POINT))
    points = points.where(physics.quality_pass(F.col("yo_clean"), F.col("most"), **qc)).join(grid, list(POINT))
    if noise is not None:
        points = points.join(noise, list(POINT), "left")
    added = F.coalesce(F.col("noise"), F.lit(0.0)) if noise is not None else F.lit(0.0)
    # The number follows from the indices, so no sort over all points is needed.
    number = (F.col("i").cast("long") * (1 << 24) + F.col("j")) * (1 << 12) + F.col("k")
    return points.select(number.alias("obs_id"), *POINT, "x_km", "y_km", "z_km", (F.col("yo_clean") + added).alias("yo"), "yo_clean", F.lit(float(r0)).alias("r0"))


def noise_field(spark, shape: tuple[int, int, int], truth: int, variance: float) -> DataFrame:
    """A reproducible noise field: normal, seeded by the truth member. One generator makes it, in order of i, j, k;
    a task draws it an i-slab at a time."""
    nx, ny, nz = shape

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for seed in b["seed"]:
                rng = np.random.default_rng(int(seed))
                j, k = (x.ravel().astype(np.int32) for x in np.indices((ny, nz)))
                for i in range(nx):
                    drawn = rng.normal(0.0, np.sqrt(variance), (ny, nz)).astype(np.float32)
                    yield pd.DataFrame({"i": np.int32(i), "j": j, "k": k, "noise": drawn.astype(float).ravel()})

    return spark.createDataFrame([(42 + truth,)], "seed int").mapInPandas(rows, "i int, j int, k int, noise double")


def live_levels(state: DataFrame, *names: str) -> DataFrame:
    """Rows of levels with at least one number in those columns."""
    some = F.lit(False)
    for n in names:
        some = some | (F.col(n).isNotNull() & ~F.isnan(n))
    return state.join(state.groupBy("k").agg(F.bool_or(some).alias("live")).where("live").select("k"), "k", "left_semi")


def candidates(points: DataFrame, *, dbz_min: float = 5.0, least_spread: float = 1.0) -> DataFrame:
    """For each kind (A: near the mean and strong, B: most above, C: most below) the best point.
    points: i, j, k, yo, d (innovation), spread. Ties go to the first in order of i, j, k."""
    good = points.where((F.col("yo") > dbz_min) & (F.col("spread") > least_spread))
    scores = {"A": -F.abs("d") + F.when(F.col("yo") > 30, 5.0).otherwise(0.0), "B": F.col("d"), "C": -F.col("d")}
    place = F.struct(*((-F.col(x)).alias(x) for x in POINT))
    best = good.agg(*(F.max(F.struct(s.alias("score"), place.alias("at"), "yo", "d")).alias(n) for n, s in scores.items()))
    rows = best.select(F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.col(n).alias("b")) for n in scores))).alias("r"))
    return rows.where("r.b is not null").select("r.kind", *((-F.col(f"r.b.at.{x}")).alias(x) for x in POINT), F.col("r.b.score").alias("score"))


def snapshot_difference(rain: DataFrame) -> DataFrame:
    """Accumulation since the snapshot before. rain: m, i, j, ts, rain."""
    return rain.withColumn("accumulated", F.col("rain") - F.lag("rain").over(Window.partitionBy("m", "i", "j").orderBy("ts")))


def mean_accumulation(rain: DataFrame) -> DataFrame:
    """The mean over members of snapshot_difference, at each point and time that has one."""
    return snapshot_difference(rain).where("accumulated is not null").groupBy("i", "j", "ts").agg(F.avg("accumulated").alias("accumulated"), F.count("accumulated").alias("members"))
