"""Experiment runner: sweep, single_obs and multi_obs from a configuration.

Keys of a configuration: ``experiment_tag``, ``verbose``, ``skip_existing``, ``store_fields``, ``cutoff_factor``;
``paths`` {prepared, outdir}; ``state`` {n_members, var_idx}; ``obs`` {obs_error_var, add_noise}; ``qc`` {dbz_min,
filter_ensemble, filter_truth, filter_mode}; ``sweep`` {truth_members, prior_size, obs_points (a mode, or {mode, loc
{x, y, z}, stride}), stride, methods, ntemp, alpha_s, loc_x, loc_y, loc_z}. Shorter ones are taken as well: ``mode``,
``truth_member``, ``prior_size`` and ``point`` at the top, ``prepared`` and ``outdir`` there, and ``method``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics, tempering
from ..log import say, set_verbosity
from ..operators import combos as combo_ops
from ..operators import ensemble, multi_obs, neighbours, single_obs, verification
from ..operators import steps as kernel_steps
from ..schema import POINT, VARIABLES
from ..sources import config as configs
from ..sources import extract, results

#: Steps up to which a sweep is window aggregates; more go to the kernel of all steps.
NESTED = 3
#: Other names of modes.
ALIASES = {"strided": "multi_obs"}


def _obs_points(config: dict) -> dict:
    given = config.get("sweep", {}).get("obs_points", config.get("obs_points", {}))
    return {"mode": given} if isinstance(given, str) else dict(given or {})


def mode_of(config: dict) -> str:
    mode = config.get("mode", _obs_points(config).get("mode", "sweep"))
    mode = mode.get("type", "sweep") if isinstance(mode, dict) else mode
    mode = ALIASES.get(mode, mode)
    if mode not in ("sweep", "single_obs", "multi_obs"):
        raise ValueError(f"mode {mode}")
    return mode


def truth_of(config: dict, given: int | None = None) -> int:
    if given is not None:
        return given
    value = config.get("sweep", {}).get("truth_members", config.get("truth_member", 0))
    return int(value[0] if isinstance(value, list) else value)


def prior_size_of(config: dict) -> int | None:
    value = config.get("sweep", {}).get("prior_size", config.get("prior_size"))
    return None if value is None else int(value)


def point_of(config: dict) -> tuple[int, int, int]:
    """The observation of single_obs."""
    if "point" in config:
        return tuple(int(config["point"][a]) for a in "ijk")
    at = _obs_points(config)["loc"]
    return tuple(int(at[a]) for a in "xyz")


def path_of(config: dict, name: str) -> str:
    return config["paths"][name] if "paths" in config else config[name]


def steps_of(rows: list[tuple]) -> int:
    """Steps that a list of combinations needs."""
    most = {"LETKF": lambda n: 1, "AOEI": lambda n: 1, "ATEnKF": lambda n: 20}
    return max(most.get(c[0], lambda n: n)(c[1]) for c in rows)


def observations_of(spark: SparkSession, config: dict, truth: int, grid: DataFrame, own: DataFrame, prior: DataFrame) -> DataFrame:
    mode, obs_config, sweep, qc = mode_of(config), config.get("obs", {}), config.get("sweep", {}), config.get("qc")
    r0 = float(obs_config.get("obs_error_var", 5.0))
    noise = None
    if obs_config.get("add_noise", False):
        shape = tuple(n + 1 for n in grid.agg(F.max("i"), F.max("j"), F.max("k")).first())
        noise = ensemble.noise_field(spark, shape, truth, r0)
    options = {"filter_ensemble": False, "filter_truth": False} if not qc or mode == "single_obs" else {"dbz_min": float(qc.get("dbz_min", 5.0)), "filter_ensemble": qc.get("filter_ensemble", True), "filter_truth": qc.get("filter_truth", False), "mode": qc.get("filter_mode", "and")}
    stride = 1 if mode == "single_obs" else int(sweep.get("stride", _obs_points(config).get("stride", 1)))
    obs = ensemble.observations(own, prior, grid, stride=stride, r0=r0, noise=noise, **options)
    if mode == "single_obs":
        obs = obs.where(" and ".join(f"{a} = {v}" for a, v in zip("ijk", point_of(config), strict=True)))
    return obs


def run(spark: SparkSession, config: dict, state: DataFrame, grid: DataFrame, *, truth: int | None = None, outdir: str | None = None) -> DataFrame:
    """The result rows of a configuration. With store_fields and an outdir, sweep and single_obs write the analysed zones
    there (fields, by combination). In mode multi_obs with an outdir, also writes there the reference (once),
    each combination's analysis (its mean; with store_fields all members) and steps; with skip_existing, combinations
    that are there are taken from there."""
    mode, tm = mode_of(config), truth_of(config, truth)
    prior = ensemble.prior_of(state, tm, prior_size_of(config))
    own = ensemble.truth_of(state, tm)
    obs = observations_of(spark, config, tm, grid, own, prior)
    sweep = config.get("sweep", {})
    rows = combo_ops.combinations(sweep)
    table = combo_ops.combo_table(spark, sweep)
    say(1, "mode %s, truth %d, %d combinations", mode, tm, len(rows))
    if mode != "multi_obs":
        steps = steps_of(rows)
        pairs = neighbours.localised_pairs(obs, table, grid)
        if "cutoff_factor" in config:
            pairs = neighbours.in_box(pairs, grid, float(config["cutoff_factor"]))
        if any(r[0] == "ATEnKF" for r in rows) or steps > NESTED:
            done = kernel_steps.analyse(pairs, prior)
        else:
            done = single_obs.analyse(single_obs.with_members(pairs, prior), steps)
        if outdir and config.get("store_fields", False):
            done = multi_obs.stored(done)  # fields and metrics both read it
            results.write_zones(single_obs.zone_fields(done), f"{outdir}/fields/tm={tm}")
        return single_obs.metrics(single_obs.with_truth(single_obs.moments(done), own))
    if outdir:
        results.write_reference(reference(own, prior, obs), f"{outdir}/reference/tm={tm}")
    todo = {r.combo_id for r in (results.unfinished(spark, table, f"{outdir}/metrics/tm={tm}") if outdir and config.get("skip_existing", False) else table).collect()}
    out = None
    for n, (method, ntemp, alpha, *scales) in enumerate(rows):
        if n in todo:
            done = multi_obs.assimilate(prior, obs, grid, method=method, ntemp=ntemp, alpha_s=alpha, scales=tuple(scales))
            part = verification.global_metrics(verification.by_variable(done.state, own)).select(F.lit(n).alias("combo_id"), F.lit(method).alias("method"), F.lit(ntemp).alias("ntemp"), "*")
            if outdir:
                fields = done.state if config.get("store_fields", False) else verification.means(done.state)
                results.write_analysis(fields, f"{outdir}/analysis/tm={tm}", n)
                results.write_analysis(done.steps, f"{outdir}/steps/tm={tm}", n)
                results.write_analysis(done.n_obs, f"{outdir}/n_obs/tm={tm}", n)
                results.write_analysis(part.drop("combo_id"), f"{outdir}/metrics/tm={tm}", n)  # last: its being there tells that all is
            say(1, "combination %d: %s with %d steps done", n, method, ntemp)
        else:
            say(2, "combination %d is there", n)
            part = spark.read.parquet(f"{outdir}/metrics/tm={tm}").where(F.col("combo_id") == n)
        out = part if out is None else out.unionByName(part)
    return out


def reference(truth: DataFrame, prior: DataFrame, obs: DataFrame) -> DataFrame:
    """What all combinations share, a row for each point: the truth and its reflectivity, the prior's mean, and the
    observation where there is one."""
    mean = prior.groupBy(*POINT).agg(*(F.avg(x).alias(f"xf_mean_{x}") for x in VARIABLES))
    own = truth.select(*POINT, *(F.col(x).alias(f"truth_{x}") for x in VARIABLES), physics.h().alias("truth_hx"))
    return own.join(mean, list(POINT), "left").join(obs.select(*POINT, "yo", "yo_clean"), list(POINT), "left")


def sanity_report(spark: SparkSession, obs: DataFrame, grid: DataFrame, prior: DataFrame, *, ntemp: int = 3, alpha_s: float = 2.0, scale: float = 5.0) -> DataFrame:
    """Each method at given observations: departure and spread before and after, and whether it is worse."""
    rows = [(m, n, alpha_s, scale, scale, scale) for m, n in (("LETKF", 1), ("TEnKF", ntemp), ("AOEI", 1), ("ATEnKF", 1), ("TAOEI", ntemp))]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], combo_ops.COMBOS)
    pairs = neighbours.localised_pairs(obs, table, grid)
    done = kernel_steps.analyse(pairs, prior).where("at_obs")
    cells = single_obs.moments(done)
    before, after = F.col("yo") - F.col("mf_ref"), F.col("yo") - F.col("ma_ref")
    return cells.select("obs_id", "method", before.alias("dep_b"), after.alias("dep_a"), F.col("sf_ref").alias("spread_b"), F.col("sa_ref").alias("spread_a"), (F.abs(after) > F.abs(before)).alias("worse"))


def prior_report(obs: DataFrame, prior: DataFrame) -> DataFrame:
    """The prior at the observations: observed value, mean, spread, least and largest member, variance against the error."""
    seen = prior.withColumn("y", physics.h()).join(obs.select("obs_id", *POINT, "yo", "r0"), list(POINT))
    out = seen.groupBy("obs_id", "yo", "r0").agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("spread"), F.min("y").alias("least"), F.max("y").alias("largest"), F.count("y").alias("members"))
    return out.withColumn("variance_to_error", F.col("spread") * F.col("spread") / F.col("r0"))


def schedule_preview(spark: SparkSession, ntemp: int, alpha_s: float, r0: float) -> DataFrame:
    """step, weight and error variance of a tempering schedule."""
    rows = spark.range(1, ntemp + 1).select(F.col("id").cast("int").alias("step"))
    weight = tempering.step_weight(F.lit(ntemp), F.lit(float(alpha_s)), F.col("step"))
    return rows.select("step", weight.alias("weight"), (F.lit(float(r0)) / weight).alias("error"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config", required=True, help="a YAML or JSON file")
    parser.add_argument("--tm", type=int, help="truth member, in place of the configuration's")
    parser.add_argument("--verbose", type=int, help="0 to 3, in place of the configuration's")
    parser.add_argument("--workers", type=int, default=0, help="threads where no cluster is configured; a cluster has its own")
    parser.add_argument("--sanity", action="store_true", help="show the reports at the observation of obs_points.loc instead")
    args = parser.parse_args(argv)
    config = configs.load(args.config)
    set_verbosity(config.get("verbose", 1) if args.verbose is None else args.verbose)
    builder = SparkSession.builder.appName("cirrostrat")
    spark = (builder.master(f"local[{args.workers}]") if args.workers else builder).getOrCreate()
    state, grid = extract.import_prepared(spark, path_of(config, "prepared"))
    tm, sweep = truth_of(config, args.tm), config.get("sweep", {})
    if args.sanity:
        one = config | {"mode": "single_obs"}
        prior = ensemble.prior_of(state, tm, prior_size_of(config))
        obs = observations_of(spark, one, tm, grid, ensemble.truth_of(state, tm), prior)
        ntemp, alpha = int(max(combo_ops.expand(sweep.get("ntemp", 3)))), float(max(combo_ops.expand(sweep.get("alpha_s", 2.0))))
        prior_report(obs, prior).show(truncate=False)
        schedule_preview(spark, ntemp, alpha, float(config.get("obs", {}).get("obs_error_var", 5.0))).show(truncate=False)
        sanity_report(spark, obs, grid, prior, ntemp=ntemp, alpha_s=alpha, scale=float(max(combo_ops.expand(sweep.get("loc_x", 5.0))))).show(truncate=False)
        return
    tag = config.get("experiment_tag", "EXP")
    outdir = f"{path_of(config, 'outdir').rstrip('/')}/{tag}"
    results.copy_config(spark, config, f"{outdir}/config")
    members = state.select("m").distinct().count() - 1
    size = prior_size_of(config) or members
    rows = run(spark, config, state, grid, truth=args.tm, outdir=f"{outdir}/{mode_of(config)}")
    results.write_sweep(rows, f"{outdir}/results", mode_name=mode_of(config), members=size, truth=tm)
    say(1, "results in %s", outdir)


if __name__ == "__main__":
    main()
