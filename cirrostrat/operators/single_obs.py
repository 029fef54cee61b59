"""Analyses with one observation each, in closed form.

With one observation the ensemble transform needs only, over the members: the
covariance c of a variable with the observed quantity y, the variance of y and
its mean. With r the localised error, d the departure and
g = sqrt(r / (r + var(y))):

    x_m := x_m + c * ((y_m - mean(y)) / var(y) * (g - 1) + d / (r + var(y)))

So an analysis is window aggregates over members. All rows of an observation
are dealt to one task once; every step's windows then need no further exchange.
An observation's rows are its localisation zone times the ensemble, whatever the
size of the domain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics, stats, tempering
from ..schema import POINT, VARIABLES

KEYS = ("obs_id", "combo_id")
CELL = (*KEYS, "gi", "gj", "gk")
META = ("method", "ntemp", "alpha_s", "lx", "ly", "lz", "yo", "yo_clean", "i", "j", "k")


def with_members(pairs: DataFrame, prior: DataFrame) -> DataFrame:
    """Pairs by the members at their grid points; f_ columns keep the prior."""
    members = prior.select(*(F.col(a).alias(f"g{a}") for a in POINT), "m", *VARIABLES)
    rows = pairs.join(members, ["gi", "gj", "gk"])
    at_obs = (F.col("gi") == F.col("i")) & (F.col("gj") == F.col("j")) & (F.col("gk") == F.col("k"))
    return rows.withColumns({"at_obs": at_obs, **{f"f_{x}": F.col(x) for x in VARIABLES}})


def _step(rows: DataFrame, step: int) -> DataFrame:
    of_member = Window.partitionBy(*KEYS, "m")
    of_cell = Window.partitionBy(*CELL)
    rows = rows.withColumn("y", F.max(F.when(F.col("at_obs"), physics.h())).over(of_member))
    rows = rows.withColumns({"y_mean": F.avg("y").over(of_cell), "y_var": F.var_samp("y").over(of_cell), **{f"c_{x}": F.covar_samp(x, "y").over(of_cell) for x in VARIABLES}})
    d = F.col("yo") - F.col("y_mean")
    adaptive = tempering.adaptive_error(d, F.col("y_var"), F.col("r0"))
    if step == 1:
        rows = rows.withColumns({"dep_b": d, "y_mean_b": F.col("y_mean"), "y_sd_b": F.sqrt("y_var"), "own_ntemp": tempering.solve_ntemp(adaptive / F.greatest("r0", F.lit(1e-30)), F.col("alpha_s"))})
    r = tempering.error_of_step(F.col("method"), step, F.col("ntemp"), F.col("alpha_s"), F.col("r0"), adaptive, F.col("own_ntemp"))
    rows = rows.withColumn("r_step", r)
    local = physics.localised_error(F.col("r_step"), F.col("d2"))
    var = F.col("y_var")
    factor = (F.col("y") - F.col("y_mean")) / var * (F.sqrt(local / (local + var)) - 1.0) + d / (local + var)
    active = F.col("updated") & F.col("r_step").isNotNull() & (var > 0)
    return rows.withColumns({x: F.when(active, F.col(x) + F.col(f"c_{x}") * factor).otherwise(F.col(x)) for x in VARIABLES}).withColumn(f"err_{step}", F.col("r_step"))


def own_steps(rows: DataFrame) -> int:
    """The most steps that ATEnKF needs for an observation in rows of with_members (runs a job)."""
    most = _step(rows.repartition(*KEYS), 1).where(F.col("method") == "ATEnKF").agg(F.max("own_ntemp")).first()[0]
    return int(most or 1)


def analyse(rows: DataFrame, steps: int) -> DataFrame:
    """rows of with_members after that many steps; a method that needs fewer is left alone in the others.
    ATEnKF needs own_steps, which are up to 20."""
    rows = rows.repartition(*KEYS)
    return reduce(lambda r, s: _step(r, s), range(1, steps + 1), rows)


def moments(rows: DataFrame) -> DataFrame:
    """For each observation, combination and grid point: mean and spread of all variables and of reflectivity,
    before (f) and after (a)."""
    aggregates = []
    for x in VARIABLES:
        aggregates += [F.avg(f"f_{x}").alias(f"mf_{x}"), F.avg(x).alias(f"ma_{x}"), F.stddev_samp(f"f_{x}").alias(f"sf_{x}"), F.stddev_samp(x).alias(f"sa_{x}")]
    for frame, tag in (("f_", "f"), ("", "a")):
        aggregates += [F.avg(physics.h(frame)).alias(f"m{tag}_ref"), F.stddev_samp(physics.h(frame)).alias(f"s{tag}_ref")]
    kept = [F.first(c).alias(c) for c in ("rho", "d2", "at_obs", "method", "ntemp", "alpha_s", "lx", "ly", "lz", "yo", "yo_clean", "x_km", "y_km", "z_km", "i", "j", "k", "updated")]
    return rows.groupBy(*CELL).agg(*aggregates, *kept)


def with_truth(cells: DataFrame, truth: DataFrame) -> DataFrame:
    t = truth.select(*(F.col(a).alias(f"g{a}") for a in POINT), *(F.col(x).alias(f"t_{x}") for x in VARIABLES), physics.h().alias("t_ref"))
    return cells.join(t, ["gi", "gj", "gk"])


def metrics(cells: DataFrame) -> DataFrame:
    """One row for each observation, combination and quantity: errors and spreads over the localisation zone."""
    names = (*VARIABLES, "ref")
    aggregates = [F.max(F.when(F.col("at_obs"), F.col("ma_ref"))).alias("hxa_mean"), F.max(F.when(F.col("at_obs"), F.col("mf_ref"))).alias("hxf_mean")]
    for x in names:
        for tag in "fa":
            e, s = F.col(f"m{tag}_{x}") - F.col(f"t_{x}"), F.col(f"s{tag}_{x}")
            aggregates += [stats.rmse(e).alias(f"rmse_{tag}_{x}"), F.avg(s).alias(f"spread_{tag}_{x}"), stats.weighted_rmse(e, F.col("rho")).alias(f"rmse_{tag}_w_{x}"), stats.weighted(s, F.col("rho")).alias(f"spread_{tag}_w_{x}")]
    return _by_quantity(cells.groupBy(*KEYS).agg(*aggregates, *(F.first(c).alias(c) for c in META)))


def _by_quantity(wide: DataFrame) -> DataFrame:
    """A row for each quantity of a row of metrics."""
    measures = [f"{a}_{t}{w}" for t in "fa" for a, w in (("rmse", ""), ("spread", ""), ("rmse", "_w"), ("spread", "_w"))]
    each = F.array(*(F.struct(F.lit(x).alias("var"), *(F.col(f"{m}_{x}").alias(m) for m in measures)) for x in (*VARIABLES, "ref")))
    out = wide.withColumn("e", F.explode(each)).select(*KEYS, *META, "hxf_mean", "hxa_mean", F.col("e.*"))
    return out.withColumns({"dep_b": F.col("yo") - F.col("hxf_mean"), "dep_a": F.col("yo") - F.col("hxa_mean")})


def sweep(obs: DataFrame, combos: DataFrame, grid: DataFrame, prior: DataFrame, truth: DataFrame, *, steps: int, cutoff: str = "reference") -> DataFrame:
    """Every observation is an analysis of its own, for every combination. Zones near their observation are analysed
    by parts of the domain; without a horizontal scale a zone is the whole domain and its rows go through windows."""
    from . import neighbours, zones

    if zones.fits(combos):
        return _by_quantity(zones.sweep(obs, combos, grid, prior, truth, most_steps=steps, cutoff=cutoff).join(F.broadcast(combos), "combo_id"))
    pairs = neighbours.localised_pairs(obs, combos, grid, cutoff=cutoff)
    return metrics(with_truth(moments(analyse(with_members(pairs, prior), steps)), truth))


def zone_statistics(cells: DataFrame) -> DataFrame:
    """Single-observation report, a row for each observation and combination: bias, error and root-mean-square
    spread over the zone, weighted and not, and the quantities at the observation."""
    aggregates = [F.sum("rho").alias("loc_weights_sum"), F.count(F.lit(1)).alias("n_updated"), F.first("yo").alias("yo")]
    here = lambda c: F.max(F.when(F.col("at_obs"), F.col(c)))
    aggregates += [here(f"{a}{t}_ref").alias(f"{n}_{t}_obs") for t in "fa" for a, n in (("m", "hx_mean"), ("s", "spread"))]
    for x in VARIABLES:
        for tag in "fa":
            e, s = F.col(f"m{tag}_{x}") - F.col(f"t_{x}"), F.col(f"s{tag}_{x}")
            w = F.col("rho")
            aggregates += [
                stats.weighted_rmse(e, w).alias(f"rmse_{tag}_w_{x}"), stats.weighted(e, w).alias(f"bias_{tag}_w_{x}"), stats.weighted_rmse(s, w).alias(f"spread_{tag}_w_{x}"),
                stats.rmse(e).alias(f"rmse_{tag}_u_{x}"), F.avg(e).alias(f"bias_{tag}_u_{x}"), stats.spread_rms(s).alias(f"spread_{tag}_u_{x}"), here(f"m{tag}_{x}").alias(f"x{tag}_mean_{x}"),
            ]
        aggregates.append(here(f"t_{x}").alias(f"truth_{x}"))
    out = cells.groupBy(*KEYS).agg(*aggregates)
    return out.withColumns({"dep_b": F.col("yo") - F.col("hx_mean_f_obs"), "dep_a": F.col("yo") - F.col("hx_mean_a_obs"), "inc_obs": F.col("hx_mean_a_obs") - F.col("hx_mean_f_obs")})


def zone_observation_statistics(cells: DataFrame) -> DataFrame:
    """The rest of that report: where the observation is (the point with the largest weight), the levels of the
    zone from the first to the last, and errors of the reflectivity of the mean over the zone."""
    aggregates = []
    for tag in "fa":
        e, w = physics.h(f"m{tag}_") - F.col("t_ref"), F.col("rho")
        aggregates += [stats.weighted_rmse(e, w).alias(f"rmse_{tag}_obs_w"), stats.weighted(e, w).alias(f"bias_{tag}_obs_w"), stats.rmse(e).alias(f"rmse_{tag}_obs_u"), F.avg(e).alias(f"bias_{tag}_obs_u")]
    out = cells.groupBy(*KEYS).agg(F.max_by(F.struct("gi", "gj", "gk"), "rho").alias("at"), F.min("gk").alias("k_first"), F.max("gk").alias("k_last"), *aggregates)
    return out.select(*KEYS, F.col("at.gi").alias("i0"), F.col("at.gj").alias("j0"), F.col("at.gk").alias("k0"), *(c for c in out.columns if c not in (*KEYS, "at")))


def zone_fields(rows: DataFrame) -> DataFrame:
    """The analysed zone itself: for each observation, combination, grid point and member the variables after all steps.
    rows: as analyse gives them."""
    return rows.select(*KEYS, *(F.col(f"g{a}").alias(a) for a in POINT), "m", *VARIABLES)


def raised_errors(rows: DataFrame) -> DataFrame:
    """For each combination, observations and those whose error the first step raised. rows: as analyse gives them."""
    each = rows.where("at_obs").groupBy(*KEYS).agg((F.max("err_1") > F.max("r0") + 1e-6).alias("raised"))
    return each.groupBy("combo_id").agg(F.count(F.lit(1)).alias("n_obs"), F.count_if("raised").alias("n_raised"))
