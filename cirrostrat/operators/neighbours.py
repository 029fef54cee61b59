"""Localisation range join and nearest points.

A bare distance predicate would be planned as a product of both sides. Here
grid points have a tile, observations are repeated to the tiles that their
radius touches, and the join is on the tile; each pair is met once, as a point
is in one tile."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics
from . import multi_obs


def _tile(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("int")


def range_join(obs: DataFrame, grid: DataFrame, radius: Column, tile_km: float) -> DataFrame:
    """obs (x_km, y_km, z_km and more) by grid points (as gx, gy, gz; i, j, k of the point as gi, gj, gk)
    within radius in both horizontal directions. Apply the exact predicate to the result."""
    points = grid.select(F.col("i").alias("gi"), F.col("j").alias("gj"), F.col("k").alias("gk"), F.col("x_km").alias("gx"), F.col("y_km").alias("gy"), F.col("z_km").alias("gz"))
    points = points.withColumns({"tx": _tile(F.col("gx"), tile_km), "ty": _tile(F.col("gy"), tile_km)})
    ends = lambda c: F.explode(F.sequence(_tile(F.col(c) - F.col("__r"), tile_km), _tile(F.col(c) + F.col("__r"), tile_km)))
    spread = obs.withColumn("__r", radius).withColumn("tx", ends("x_km")).withColumn("ty", ends("y_km"))
    near = (F.abs(F.col("gx") - F.col("x_km")) <= F.col("__r")) & (F.abs(F.col("gy") - F.col("y_km")) <= F.col("__r"))
    return spread.join(points, ["tx", "ty"]).where(near).drop("tx", "ty", "__r")


def localised_pairs(obs: DataFrame, combos: DataFrame, grid: DataFrame, *, cutoff: str = "reference", tile_km: float | None = None) -> DataFrame:
    """Observations x combinations x grid points in the zone of the metrics (or of the update, where that is
    larger and not the reference's): d2, rho and whether the point is updated. An axis without scale is unbounded
    and joins all tiles."""
    scales = [F.col(c) for c in ("lx", "ly", "lz")]
    reach = math.sqrt(physics.SUPPORT2)
    longest = F.greatest("lx", "ly") * reach
    size = tile_km or float(combos.agg(F.max(F.greatest("lx", "ly"))).first()[0] or 1.0) * reach
    free = combos.where((F.col("lx") <= physics.NO_SCALE) | (F.col("ly") <= physics.NO_SCALE)).limit(1).count()
    both = obs.crossJoin(F.broadcast(combos))
    if free:
        extent = grid.agg(F.greatest(F.max("x_km") - F.min("x_km"), F.max("y_km") - F.min("y_km"))).first()[0] or 0.0
        longest = F.when((F.col("lx") <= physics.NO_SCALE) | (F.col("ly") <= physics.NO_SCALE), F.lit(float(extent) + 1.0)).otherwise(longest)
        size = max(size, float(extent) / 16 + 1e-6)
    pairs = range_join(both, grid, longest, size)
    d2 = physics.distance2(F.col("gx") - F.col("x_km"), F.col("gy") - F.col("y_km"), F.col("gz") - F.col("z_km"), *scales)
    pairs = pairs.withColumn("d2", d2).where(F.col("d2") <= physics.SUPPORT2)
    return pairs.withColumns({"rho": physics.weight(F.col("d2")), "updated": F.col("d2") <= physics.cutoff2(*scales, kind=cutoff)})


def in_box(pairs: DataFrame, grid: DataFrame, factor: float) -> DataFrame:
    """Pairs of localised_pairs within an index box about the observation: factor times the scale, in steps of the grid
    there (of 0.1 km at least), and levels within factor times the vertical scale. An axis with scale 0 keeps its own index."""
    at = grid.select(*(F.col(a).alias(f"n{a}") for a in "ijk"), F.col("x_km").alias("nx"), F.col("y_km").alias("ny"))
    own = pairs.select("obs_id", "i", "j", "k", "x_km", "y_km").distinct()
    ends = grid.agg(F.max("i").alias("i1"), F.max("j").alias("j1"))
    own = own.crossJoin(F.broadcast(ends))
    for axis, x in (("i", "x"), ("j", "y")):
        other = "j" if axis == "i" else "i"
        beside = F.when(F.col(axis) < F.col(f"{axis}1"), F.col(axis) + 1).otherwise(F.col(axis) - 1)
        n = at.select(F.col(f"n{axis}").alias("b"), F.col(f"n{other}").alias(other), F.col("nk").alias("k"), F.col(f"n{x}").alias(f"beside_{x}"))
        own = own.withColumn("b", beside).join(n, ["b", other, "k"], "left").drop("b")
        own = own.withColumn(f"d{x}", F.greatest(F.abs(F.col(f"beside_{x}") - F.col(f"{x}_km")), F.lit(0.1)))
    pairs = pairs.join(own.select("obs_id", "dx", "dy"), "obs_id")
    inside = (F.abs(F.col("gi") - F.col("i")) <= F.ceil(factor * F.col("lx") / F.col("dx"))) & (F.abs(F.col("gj") - F.col("j")) <= F.ceil(factor * F.col("ly") / F.col("dy")))
    pairs = pairs.where(F.coalesce(inside, F.lit(True)) & (F.abs(F.col("gz") - F.col("z_km")) <= factor * F.col("lz")))
    return pairs.drop("dx", "dy")


#: Targets that are held against every point in one pass; more go by cells.
FEW = 64


def nearest(points: DataFrame, targets: DataFrame, *, few: int = FEW) -> DataFrame:
    """For each target (name, lat, lon) the grid point (j, i) at the least squared distance in degrees; ties go to the
    first in order of j, i. points: j, i, lat, lon. A few targets take one pass over the points; more meet the points
    of the cells around them."""
    if targets.limit(few + 1).count() > few:
        return _nearest_by_cells(points, targets)
    t = F.broadcast(targets.select("name", F.col("lat").alias("tlat"), F.col("lon").alias("tlon")))  # few rows
    best = points.crossJoin(t).groupBy("name").agg(F.min(F.struct(_degrees2().alias("d2"), "j", "i")).alias("b"))
    return best.select("name", "b.j", "b.i", "b.d2")


def _degrees2() -> Column:
    return F.pow(F.col("lat") - F.col("tlat"), F.lit(2.0)) + F.pow(F.col("lon") - F.col("tlon"), F.lit(2.0))


def _nearest_by_cells(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Points have a cell; a target looks into the cells around its own, which may lie outside of all points, and a
    target that found nothing as near as the edge of what it looked at looks further, twice as far each time. The
    driver holds the extent of the points. Points and targets without a place don't count."""
    spark = points.sparkSession
    here = lambda df: df.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    points = here(points).select("j", "i", "lat", "lon")
    lat0, lat1, lon0, lon1, n = points.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon"), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], f"name {dict(targets.dtypes)['name']}, j int, i int, d2 double")
    height, width = lat1 - lat0, lon1 - lon0
    size = max(2 * math.sqrt(height * width / n), max(height, width) / n, max(height, width) / (1 << 30)) or 1.0
    cell = lambda c, low: F.floor((F.col(c) - low) / size).cast("long")
    rows, columns = int(height // size), int(width // size)  # the last cell of each axis
    points = points.withColumns({"cy": F.least(cell("lat", lat0), F.lit(rows)), "cx": F.least(cell("lon", lon0), F.lit(columns))})
    waiting = here(targets).select("name", F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    waiting = waiting.withColumns({"ty": F.floor((F.col("tlat") - lat0) / size), "tx": F.floor((F.col("tlon") - lon0) / size)})
    outside = F.greatest(F.lit(0), -F.col("ty"), F.col("ty") - rows, -F.col("tx"), F.col("tx") - columns)
    waiting, found, further = multi_obs.stored(waiting.withColumn("outside", outside)), None, 1
    while True:
        reach = F.col("outside") + further
        ends = lambda c, last: F.sequence(F.greatest(F.col(c) - reach, F.lit(0)), F.least(F.col(c) + reach, F.lit(last)))  # noqa: B023, E731
        around = waiting.withColumn("cy", F.explode(ends("ty", rows))).withColumn("cx", F.explode(ends("tx", columns)))
        best = around.join(points, ["cy", "cx"]).groupBy("name", "tlat", "tlon", "ty", "tx", "outside").agg(F.min(F.struct(_degrees2().alias("d2"), "j", "i")).alias("b"))
        edge = F.pow(reach * (size * (1 - 1e-9)), F.lit(2.0))
        all_seen = (F.col("ty") - reach <= 0) & (F.col("tx") - reach <= 0) & (F.col("ty") + reach >= rows) & (F.col("tx") + reach >= columns)
        done = best.where((F.col("b.d2") <= edge) | all_seen).select("name", "b.j", "b.i", "b.d2")
        done = multi_obs.stored(done)
        found = done if found is None else found.unionByName(done)
        waiting = multi_obs.stored(waiting.join(done.select("name"), "name", "left_anti"))
        if not waiting.limit(1).count():
            return found
        further *= 2


def positions(points: DataFrame) -> DataFrame:
    """km east, north and up of the corner (0, 0). points: i, j, k, lat, lon, z_m."""
    corner = points.where("i = 0 and j = 0").agg(F.first("lat").alias("lat0"), F.first("lon").alias("lon0"))
    east, north = physics.east_north_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    return points.crossJoin(F.broadcast(corner)).select("i", "j", "k", east.alias("x_km"), north.alias("y_km"), (F.col("z_m") / 1000.0).alias("z_km"))


def bounding_box(points: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Index box of two corners, upper ends excluded."""
    spark = points.sparkSession
    found = nearest(points, spark.createDataFrame([("low", south, west), ("high", north, east)], "name string, lat double, lon double"))
    low, high = (F.col("name") == n for n in ("low", "high"))
    return found.agg(*(F.max(F.when(t, F.col(c) + d)).alias(n) for t, c, d, n in ((low, "j", 0, "j0"), (high, "j", 1, "j1"), (low, "i", 0, "i0"), (high, "i", 1, "i1"))))
