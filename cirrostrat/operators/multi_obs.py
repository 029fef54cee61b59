"""Analyses with many observations: a local ensemble transform at every grid point.

Grid points have tiles of twice the reach of the localisation at least, wider
where few points are in reach; a tile with very many points is cut in four, and
again, until no part has more than MOST_POINTS. So a part has about as many
points whatever the reach is, and as few of its observations are another's too.
Observations are repeated to the parts that their cutoff touches, with the
ensemble of the observed quantity as an array. Without a horizontal scale each
observation reaches every point, so points are dealt to parts by their indices
and observations go to all parts. Each part's points and observations meet in
one numpy kernel: weights, a batched eigen-decomposition, and the update, in
blocks of points and of observations. Columns are chosen before the Python
stage, as nothing is pruned below it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import folders
from ..functions import physics, tempering
from ..schema import POINT, VARIABLES

#: Points and observations that the kernel works on at once.
BLOCK = 512
#: Grid points of a part at most (unless more of them stand in one place), and how often a tile is cut in four.
MOST_POINTS, DEPTH = 4096, 6
#: How often a tile is doubled at most: less than it is cut, so that parts of dense places are still below the reach.
WIDER = 4
FAR = 1e30


def transform(y: np.ndarray, error: np.ndarray, departure: np.ndarray, inflation: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the perturbations [points, members, members], of the mean [points, members], and the covariance of
    the analysis in the space of the members [points, members, members].

    y: perturbations of the observed quantity [observations, members]; error: localised variances
    [points, observations], infinite where an observation is out of reach; departure [observations]; inflation: the
    factor of the prior's covariance."""
    members = y.shape[1]
    inverse = 1.0 / error
    a = np.zeros((len(error), members * members))
    for lo in range(0, len(y), BLOCK):
        some = y[lo : lo + BLOCK]
        a += inverse[:, lo : lo + BLOCK] @ (some[:, :, None] * some[:, None, :]).reshape(len(some), -1)
    a = a.reshape(-1, members, members)
    a[:, np.arange(members), np.arange(members)] += (members - 1) / inflation
    values, vectors = np.linalg.eigh(a)
    across = vectors.transpose(0, 2, 1)
    mean = np.einsum("pmn,pn->pm", vectors, np.einsum("pnm,pn->pm", vectors, (inverse * departure) @ y) / values)
    root = (vectors * np.sqrt((members - 1) / values)[:, None, :]) @ across
    return root, mean, (vectors / values[:, None, :]) @ across


@dataclass
class Points:
    """Points of a part after the analysis: their values [points, members, variables], the observations of each (0 where
    it isn't updated), and for those with covariance asked for: the members used, their covariance, and spreads from it."""

    x: np.ndarray
    used: np.ndarray
    covariance: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]


def update_points(x: np.ndarray, has: np.ndarray, at: np.ndarray, obs_at: np.ndarray, y: np.ndarray, known: np.ndarray, yo: np.ndarray, r: np.ndarray, scales: tuple[float, float, float], limit: float, *, inflation: float = 1.0, least_inflation: float = 0.0, covariance: bool = False) -> Points:
    """x [points, members, variables], of which each point has some members (has); at: their places. y [observations,
    members], of which each observation knows some (known). A point uses the members that it and all observations in
    its own reach have; with fewer than two it stays as it is. The other members of a point stay as they are."""
    out = Points(x.copy(), np.zeros(len(x), np.int64), [])
    every = obs_at, y, (~known).astype(np.float32), yo, r
    for lo in range(0, len(x), BLOCK):
        block = slice(lo, lo + BLOCK)
        close = np.ones(len(every[0]), bool)
        for axis, s in enumerate(scales):
            if s > physics.NO_SCALE:
                reach = s * math.sqrt(limit) * (1 + 1e-9)
                close &= (every[0][:, axis] >= np.fmin.reduce(at[block, axis]) - reach) & (every[0][:, axis] <= np.fmax.reduce(at[block, axis]) + reach)
        obs_at, y, lacks, yo, r = (v[close] for v in every)  # what the block's points may reach
        d2 = np.zeros((len(x[block]), len(obs_at)))
        for axis, s in enumerate(scales):
            if s > physics.NO_SCALE:
                d2 += ((at[block, axis, None] - obs_at[None, :, axis]) / s) ** 2
        near = d2 <= limit
        usable = has[block] & ~(near.astype(np.float32) @ lacks > 0)
        kinds, kind = np.unique(usable, axis=0, return_inverse=True)
        for n, members in enumerate(kinds):
            if members.sum() < 2:
                continue
            rows = np.flatnonzero(kind.ravel() == n)
            here = np.flatnonzero(near[rows].any(axis=0))
            own = x[lo + rows][:, members]
            mean = own.mean(axis=1, keepdims=True)
            none = ~near[rows].any(axis=1)
            root = np.broadcast_to(np.eye(len(own[0])) * math.sqrt(inflation), (len(rows), *[int(members.sum())] * 2)).copy()
            w = np.zeros((len(rows), int(members.sum())))
            spread = root * math.sqrt(inflation) / (members.sum() - 1)
            if len(here):
                some = np.flatnonzero(~none)
                mine, places = y[here][:, members], np.ix_(rows[some], here)
                error = np.where(near[places], r[here] / np.maximum(np.exp(-0.5 * d2[places]), 1e-6), np.inf)
                middle = mine.mean(axis=1)
                root[some], w[some], spread[some] = transform(mine - middle[:, None], error, yo[here] - middle, max(inflation, least_inflation))
            moved = ~none | (inflation != 1.0)
            change = own - mean
            new = mean + np.einsum("plv,plm->pmv", change, root + w[:, :, None])
            out.x[np.ix_(lo + rows[moved], np.flatnonzero(members))] = new[moved]
            out.used[lo + rows] = near[rows].sum(axis=1)
            if covariance:
                s = np.sqrt(np.einsum("pmv,pmn,pnv->pv", change, spread, change))
                out.covariance += [(lo + int(p), np.flatnonzero(members), c, v) for p, c, v in zip(rows, spread, s, strict=True)]
    return out


def tile_size(grid: DataFrame, reach: float, most: int) -> float:
    """The side of a tile: twice the reach, doubled while tiles with the mean number of points stay below three quarters
    of most (runs a job). Tiles without points don't count, so a far point changes nothing."""
    base = 2 * reach
    tiles = grid.groupBy(F.floor(F.col("x_km") / base), F.floor(F.col("y_km") / base)).count()
    n, points = tiles.agg(F.count(F.lit(1)), F.sum("count")).first()
    wider = 0.75 * most * n / points if n else 1.0
    return base * 2 ** min(WIDER, max(0, math.floor(math.log2(wider) / 2)))


def parts_of(grid: DataFrame, size: float, most: int) -> tuple[DataFrame, DataFrame]:
    """grid with the columns part_x, part_y, level (a cell of the tile grid of that size, halved level times), and the
    parts with their tile (tx, ty). Tiles are cut in four where they have more than most points."""
    fine = 1 << DEPTH
    cell = lambda c: F.floor(F.col(c) / (size / fine)).cast("long")
    tile = lambda c: F.floor(F.col(c) / fine)
    placed = grid.withColumns({"fx": cell("x_km"), "fy": cell("y_km")})
    cells = placed.groupBy("fx", "fy").agg(F.count(F.lit(1)).alias("points")).withColumns({"tx": tile("fx"), "ty": tile("fy")}).repartition("tx", "ty")
    up = lambda c, level: F.floor(F.col(c) / (fine >> level))
    level = F.lit(DEPTH)
    for n in reversed(range(DEPTH)):  # every window finds its rows dealt by tile
        cells = cells.withColumn(f"n{n}", F.sum("points").over(Window.partitionBy("tx", "ty", up("fx", n), up("fy", n))))
        level = F.when(F.col(f"n{n}") <= most, F.lit(n)).otherwise(level)
    cells = cells.select("fx", "fy", "tx", "ty", level.alias("level"))
    width = F.pow(F.lit(2), F.lit(DEPTH) - F.col("level")).cast("long")
    cells = cells.withColumns({"part_x": F.floor(F.col("fx") / width), "part_y": F.floor(F.col("fy") / width)})
    return placed.join(cells, ["fx", "fy"]).drop("fx", "fy", "tx", "ty"), cells.select("tx", "ty", "level", "part_x", "part_y").distinct()


def parts_alone(grid: DataFrame, size: float, most: int) -> DataFrame:
    """The parts of parts_of (runs a job). Tiles that aren't cut are only counted; cells are looked at in crowded ones."""
    fine = 1 << DEPTH
    tile = lambda c: F.floor(F.floor(F.col(c) / (size / fine)).cast("long") / fine)
    tiled = grid.select("x_km", "y_km", tile("x_km").alias("tx"), tile("y_km").alias("ty"))
    counts = folders.kept(tiled.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("points")), "tiles")
    whole = counts.where(F.col("points") <= most).select("tx", "ty", F.lit(0).alias("level"), F.col("tx").alias("part_x"), F.col("ty").alias("part_y"))
    crowded = counts.where(F.col("points") > most).select("tx", "ty")
    if not crowded.limit(1).count():
        return whole
    return whole.unionByName(parts_of(tiled.join(crowded, ["tx", "ty"], "left_semi").select("x_km", "y_km"), size, most)[1])


#: The key of a part.
PART = ["part_x", "part_y", "level"]


def deal(obs: DataFrame, grid: DataFrame, reach: list[float | None], tile_km: float | None, most: int) -> tuple[DataFrame, DataFrame]:
    """Grid points with their part, and observations (o_ and PART's names) with each part they reach."""
    own = grid.select(*POINT, "x_km", "y_km", "z_km")
    spread = obs.select(F.col("x_km").alias("ox"), F.col("y_km").alias("oy"), F.col("z_km").alias("oz"), "yo", "r", "y", "ym")
    if any(x is None for x in reach[:2]):
        n = max(1, -(-grid.count() // most))
        own = own.withColumns({"part_x": F.pmod(F.xxhash64("i", "j", "k"), F.lit(n)), "part_y": F.lit(0), "level": F.lit(0)})
        spread = spread.withColumns({"part_x": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))), "part_y": F.lit(0), "level": F.lit(0)})
    else:
        size = tile_km or tile_size(own, max(reach[:2]), most)
        own, parts = parts_of(own, size, most)
        ends = lambda c, d: F.explode(F.sequence(F.floor((F.col(c) - d) / size), F.floor((F.col(c) + d) / size)))
        spread = spread.withColumn("tx", ends("ox", reach[0])).withColumn("ty", ends("oy", reach[1])).join(parts, ["tx", "ty"])
        edge = F.lit(size) / F.pow(F.lit(2), F.col("level"))
        touches = lambda o, part, d: (F.col(o) + d >= F.col(part) * edge) & (F.col(o) - d <= (F.col(part) + 1) * edge)
        spread = spread.where(touches("ox", "part_x", reach[0]) & touches("oy", "part_y", reach[1])).drop("tx", "ty")
    return own, spread.select(*(F.col(c).alias(f"o_{c}" if c in PART else c) for c in spread.columns))  # not the points' own columns


def _meet(state: DataFrame, obs: DataFrame, grid: DataFrame, reach: list[float | None], tile_km: float | None, most: int):
    """Points with members, and observations, both with the part they meet in."""
    own, spread = deal(obs, grid, reach, tile_km, most)
    return state.select(*POINT, "m", *VARIABLES).join(own, list(POINT)).groupBy(*PART).cogroup(spread.groupBy(*(f"o_{c}" for c in PART)))


def _arrays(p: pd.DataFrame, o: pd.DataFrame):
    """Dense arrays of a part: the point and member of each row, members, values, which are there, places; and of the
    observations: places, values by member, which are known, observed values and errors."""
    point = p.groupby(list(POINT), sort=False).ngroup().to_numpy()
    members, member = np.unique(p["m"].to_numpy(), return_inverse=True)
    first = np.flatnonzero(np.r_[True, point[1:] != point[:-1]])
    x, has = np.zeros((len(first), len(members), len(VARIABLES))), np.zeros((len(first), len(members)), bool)
    x[point, member] = p[list(VARIABLES)].to_numpy(float)
    has[point, member] = True
    at = p[["x_km", "y_km", "z_km"]].to_numpy(float)[first]
    o = o.sort_values(["ox", "oy", "oz", "yo"], ignore_index=True)
    y, known = np.zeros((len(o), len(members))), np.zeros((len(o), len(members)), bool)
    if len(o):
        number = np.repeat(np.arange(len(o)), [len(v) for v in o["ym"]])
        of, values = np.concatenate(o["ym"].to_list()), np.concatenate(o["y"].to_list()).astype(float)
        place = np.minimum(np.searchsorted(members, of), len(members) - 1)
        there = members[place] == of
        y[number[there], place[there]], known[number[there], place[there]] = values[there], True
    return (point, member, members, first), (x, has, at), (o[["ox", "oy", "oz"]].to_numpy(float), y, known, o["yo"].to_numpy(float), o["r"].to_numpy(float))


def _limits(scales: tuple[float, float, float], cutoff: str) -> tuple[float, list[float | None]]:
    limit = math.sqrt(physics.SUPPORT2) * max(scales) if cutoff == "reference" else physics.SUPPORT2
    return limit, [s * math.sqrt(limit) if s > physics.NO_SCALE else None for s in scales]


def _with_numbers(state: DataFrame, obs: DataFrame) -> DataFrame:
    if "ym" in obs.columns:
        return obs
    every = [r.m for r in state.select("m").distinct().orderBy("m").collect()]  # as many as the ensemble has members
    return obs.withColumn("ym", F.array(*map(F.lit, every)).cast("array<int>"))


def letkf(state: DataFrame, obs: DataFrame, grid: DataFrame, *, scales: tuple[float, float, float], cutoff: str = "reference", tile_km: float | None = None, inflation: float = 1.0, least_inflation: float = 0.0, most_points: int = MOST_POINTS) -> DataFrame:
    """One analysis step. state: i, j, k, m and variables; obs: x_km, y_km, z_km, yo, r, y (values of members) and
    ym (their numbers, in the order of y; without it y has all members in order). Returns the state's columns and n_obs.

    A point is updated with the members that it and the observations in its own reach have; its other members, and
    points with fewer than two such members, pass through. inflation is the factor of the prior's covariance, raised to
    least_inflation where observations are; points without observation have their members' deviations inflated."""
    limit, reach = _limits(scales, cutoff)
    names = [*POINT, "m", *VARIABLES]

    def kernel(p: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        if p.empty:
            return pd.DataFrame({c: pd.Series(dtype="float64" if c in VARIABLES else "int32") for c in names}).assign(n_obs=pd.Series(dtype="int64"))
        p = p.sort_values([*POINT, "m"], ignore_index=True)
        (point, member, _, _), own, seen = _arrays(p, o)
        done = update_points(*own, *seen, scales, limit, inflation=inflation, least_inflation=least_inflation)
        out = p[names].copy()
        out[list(VARIABLES)] = done.x[point, member]
        return out.assign(n_obs=done.used[point])

    fields = ", ".join([*(f"{c} int" for c in (*POINT, "m")), *(f"{c} double" for c in VARIABLES), "n_obs long"])
    return _meet(state, _with_numbers(state, obs), grid, reach, tile_km, most_points).applyInPandas(kernel, fields)


def covariance(state: DataFrame, obs: DataFrame, grid: DataFrame, *, scales: tuple[float, float, float], cutoff: str = "reference", tile_km: float | None = None, inflation: float = 1.0, least_inflation: float = 0.0, most_points: int = MOST_POINTS) -> DataFrame:
    """The covariance of an analysis step in the space of its members, for each point with two of them at least:
    i, j, k, members (those used), covariance (row after row), and s_ and a variable's name: the spread of the
    analysis that follows from it."""
    limit, reach = _limits(scales, cutoff)

    def kernel(p: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        columns = [*POINT, "members", "covariance", *(f"s_{x}" for x in VARIABLES)]
        if p.empty:
            return pd.DataFrame({c: [] for c in columns})
        p = p.sort_values([*POINT, "m"], ignore_index=True)
        (_, _, members, first), own, seen = _arrays(p, o)
        done = update_points(*own, *seen, scales, limit, inflation=inflation, least_inflation=least_inflation, covariance=True)
        at = p[list(POINT)].to_numpy()[first]
        return pd.DataFrame([(*at[n], members[used], c.ravel(), *s) for n, used, c, s in done.covariance], columns=columns)

    fields = ", ".join([*(f"{c} int" for c in POINT), "members array<int>", "covariance array<double>", *(f"s_{x} double" for x in VARIABLES)])
    return _meet(state, _with_numbers(state, obs), grid, reach, tile_km, most_points).applyInPandas(kernel, fields)


def observed(state: DataFrame, obs: DataFrame) -> DataFrame:
    """obs with y (members' values), ym (their numbers), and the values' mean and variance, from the state."""
    y = state.withColumn("y", physics.h()).join(obs.select(*POINT), list(POINT), "left_semi").groupBy(*POINT).agg(F.array_sort(F.collect_list(F.struct("m", "y"))).alias("s"), F.avg("y").alias("y_mean"), F.var_samp("y").alias("y_var"))
    return obs.join(y.select(*POINT, F.col("s.y").alias("y"), F.col("s.m").alias("ym"), "y_mean", "y_var"), list(POINT))


@dataclass
class Analysis:
    """What an analysis gives: the state after the last step; a row for each step and observation in use; and the
    observations that each point used in the last step.

    steps: step, obs_id, hxf (values of members before the step), hxf_mean, dep, error_raw (the configured error),
    error_raised (the adaptive one) and error (of the step), own_ntemp, weight (error_raw or error_raised over error)."""

    state: DataFrame
    steps: DataFrame
    n_obs: DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder; a step's state is used twice by the next."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folders.shared_folder(spark))
    return df.checkpoint()


def assimilate(state: DataFrame, obs: DataFrame, grid: DataFrame, *, method: str = "TEnKF", ntemp: int = 1, alpha_s: float = 2.0, scales: tuple[float, float, float] = (10.0, 10.0, 4.0), cut=stored, **options) -> Analysis:
    """All steps of a method. cut: what cuts lineage between steps."""
    m, n, a = F.lit(method), F.lit(ntemp), F.lit(float(alpha_s))
    first = observed(state, obs)
    raised = tempering.adaptive_error(F.col("yo") - F.col("y_mean"), F.col("y_var"), F.col("r0"))
    own = first.select("obs_id", tempering.solve_ntemp(raised / F.greatest("r0", F.lit(1e-30)), a).alias("own_ntemp"))
    steps = {"TEnKF": ntemp, "TAOEI": ntemp, "LETKF": 1, "AOEI": 1}.get(method)
    if steps is None:
        if method != "ATEnKF":
            raise ValueError(f"method {method}")
        steps = own.agg(F.max("own_ntemp")).first()[0] or 1
    own = cut(own)
    report = n_obs = None
    for step in range(1, steps + 1):
        seen = observed(state, obs).join(own, "obs_id").withColumn("raised", raised)
        used = cut(seen.withColumn("r", tempering.error_of_step(m, step, n, a, F.col("r0"), F.col("raised"), F.col("own_ntemp"))).where("r is not null"))
        base = F.col("raised") if method in ("AOEI", "TAOEI") else F.col("r0")
        rows = used.select(F.lit(step).alias("step"), "obs_id", F.col("y").alias("hxf"), F.col("y_mean").alias("hxf_mean"), (F.col("yo") - F.col("y_mean")).alias("dep"), F.col("r0").alias("error_raw"), F.col("raised").alias("error_raised"), F.col("r").alias("error"), "own_ntemp", (base / F.col("r")).alias("weight"))
        report = rows if report is None else report.unionByName(rows)
        after = cut(letkf(state, used, grid, scales=scales, **options))
        state, n_obs = after.drop("n_obs"), after.groupBy(*POINT).agg(F.max("n_obs").alias("n_obs"))
    return Analysis(state, report, n_obs)


def first_members(state: DataFrame, n: int) -> DataFrame:
    """The first n members by number."""
    ranked = state.select("m").distinct().withColumn("rank", F.row_number().over(Window.orderBy("m"))).where(F.col("rank") <= n)
    return state.join(F.broadcast(ranked.select("m")), "m", "left_semi")
