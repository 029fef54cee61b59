"""Registered queries on the driver's tables and their SQL.

Numbers are rounded (to six decimals, large ones to three), as sums differ in
their last bits with the order of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics, stats, tempering
from ..operators import combos as combo_ops
from ..operators import ensemble, multi_obs, neighbours, single_obs, slices, verification
from ..operators import steps as kernel_steps
from ..schema import POINT, VARIABLES
from . import fixtures as fx
from . import oracle as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    own = lambda c: F.when(F.abs(c) < 100, F.round(c, 6)).otherwise(F.round(c, 3)) + 0.0  # noqa: E731  no negative zero
    return df.select(*(own(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(*names: str) -> str:
    """SQL: names rounded; 'expression AS name' too."""
    out = []
    for n in names:
        e, _, alias = n.rpartition(" AS ")
        x = e or alias
        out.append(f"CASE WHEN abs({x}) < 100 THEN round({x}, 6) ELSE round({x}, 3) END + 0e0 AS {alias}")
    return ", ".join(out)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    state = fx.state(spark, sf_dir)
    return state, ensemble.truth_of(state, fx.TRUTH), ensemble.prior_of(state, fx.TRUTH, fx.PRIOR)


def _obs(spark: SparkSession, sf_dir: str, stride: int = 1, **qc) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, truth, prior = _split(spark, sf_dir)
    return ensemble.observations(truth, prior, fx.grid(spark), stride=stride, r0=fx.R0, **qc), truth, prior


# Forward operator


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, {_r(o.h().replace('qr', '(l_discount * 0.04e0)').replace('qs', '(l_tax * 0.01e0)').replace('qg', '(l_tax * 0.02e0)').replace('* t)', '* (260e0 + l_quantity / 2))').replace('CASE WHEN t <=', 'CASE WHEN (260e0 + l_quantity / 2) <=').replace('(p /', '((l_extendedprice + 20000e0) /') + ' AS dbz')} FROM lineitem")
def reflectivity_point(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem")
    t, p = F.col("l_quantity") / 2 + 260.0, F.col("l_extendedprice") + 20000.0
    dbz = physics.reflectivity(F.col("l_discount") * 0.04, F.col("l_tax") * 0.01, F.col("l_tax") * 0.02, t, p)
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", dbz.alias("dbz"))


@query(f"WITH {o.STATE} SELECT i, j, k, {_r('avg(y) AS mean', 'stddev_samp(y) AS spread', 'max(y) AS most')}, count(*) AS members FROM (SELECT *, {o.h()} AS y FROM state) GROUP BY i, j, k")
def hx_ensemble_stats(spark, sf_dir):
    y = ensemble.with_reflectivity(fx.state(spark, sf_dir))
    return y.groupBy(*POINT).agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("spread"), F.max("y").alias("most"), F.count(F.lit(1)).alias("members"))


@query(f"WITH {o.STATE}, a AS (SELECT i, j, k, {', '.join(f'avg({x}) AS {x}' for x in VARIABLES)}, avg({o.h()}) AS mean_of_h FROM state GROUP BY i, j, k) SELECT i, j, k, {_r(o.h() + ' AS h_of_mean', 'mean_of_h')} FROM a")
def hx_of_mean_vs_mean_of_hx(spark, sf_dir):
    return verification.of_mean(fx.state(spark, sf_dir))


# Members, sampling, quality control


@query(f"WITH {o.STATE}, {o.SPLIT} SELECT 'truth' AS part, m, count(*) AS points, {_r('avg(t) AS t', 'max(qr) AS qr')} FROM truth GROUP BY m UNION ALL SELECT 'prior', m, count(*), {_r('avg(t) AS t', 'max(qr) AS qr')} FROM prior GROUP BY m")
def truth_prior_split(spark, sf_dir):
    state, _, prior = _split(spark, sf_dir)
    part = lambda df, n: df.groupBy("m").agg(F.count(F.lit(1)).alias("points"), F.avg("t").alias("t"), F.max("qr").alias("qr")).withColumn("part", F.lit(n))
    return part(state.where(F.col("m") == fx.TRUTH), "truth").unionByName(part(prior, "prior"))


for _name, _test, _qc in (
    ("and", "most >= 33 AND tr.y >= 33", {"filter_truth": True, "mode": "and"}),
    ("or", "most >= 33 OR tr.y >= 33", {"filter_truth": True, "mode": "or"}),
    ("e", "most >= 33", {}),
    ("t", "tr.y >= 33", {"filter_ensemble": False, "filter_truth": True}),
):

    def _points(spark, sf_dir, qc=_qc):
        return _obs(spark, sf_dir, 2, dbz_min=33.0, **qc)[0].select(*POINT, "yo")

    _points.__name__ = f"stride_qc_points_{_name}"
    query(f"WITH {o.STATE}, {o.GRID}, {o.SPLIT}, {o.obs(2, _test)} SELECT i, j, k, {_r('yo')} FROM obs")(_points)


@query(f"WITH {o.STATE} SELECT i, j, k, m, {_r('t', 'p')} FROM state WHERE i >= 1 AND i < 3 AND j < 3 AND k >= 1")
def box_slice(spark, sf_dir):
    return ensemble.box(fx.state(spark, sf_dir), i=(1, -1), j=(None, -1), k=(1, None)).select(*POINT, "m", "t", "p")


# Tempering and adaptive errors


@query(f"WITH s AS (SELECT CAST(n AS INT) AS ntemp, alpha_s, CAST(unnest(range(1, n + 1)) AS INT) AS step FROM range(1, 11) r(n), (VALUES (0e0), (0.5e0), (2e0), (5e0)) a(alpha_s)) SELECT ntemp, alpha_s, step, {_r(o.weight('ntemp', 'step') + ' AS weight')} FROM s")
def tempering_schedule(spark, sf_dir):
    rows = spark.range(1, 11).select(F.col("id").cast("int").alias("ntemp"), F.explode(F.array(*(F.lit(a) for a in (0.0, 0.5, 2.0, 5.0)))).alias("alpha_s"))
    rows = rows.select("ntemp", "alpha_s", F.explode(F.sequence(F.lit(1), F.col("ntemp"))).alias("step"))
    return rows.withColumn("weight", tempering.step_weight(F.col("ntemp"), F.col("alpha_s"), F.col("step")))


_HX = "hx AS (SELECT vec_id AS obs_id, label * 5e0 + 10e0 AS yo, 5e0 AS r0, unnest(range(0, len(embedding))) AS m, 20e0 + 40e0 * CAST(unnest(embedding) AS DOUBLE) AS y FROM embeddings)"
_HXA = f"{_HX}, a AS (SELECT obs_id, yo, r0, avg(y) AS y_mean, var_samp(y) AS y_var, 1e0 AS alpha_s FROM hx GROUP BY obs_id, yo, r0), b AS (SELECT *, greatest(r0, pow(yo - y_mean, 2) - y_var) AS adaptive FROM a)"


def _adaptive(spark, sf_dir):
    stat = fx.hx(spark, sf_dir).groupBy("obs_id").agg(F.avg("y").alias("y_mean"), F.var_samp("y").alias("y_var"))
    rows = stat.join(fx.hx_obs(spark, sf_dir), "obs_id")
    return rows.withColumn("adaptive", tempering.adaptive_error(F.col("yo") - F.col("y_mean"), F.col("y_var"), F.col("r0")))


@query(f"WITH {_HXA} SELECT obs_id, {_r('y_mean', 'y_var', 'adaptive')}, adaptive > r0 AS raised FROM b")
def aoei_inflation(spark, sf_dir):
    return _adaptive(spark, sf_dir).select("obs_id", "y_mean", "y_var", "adaptive", (F.col("adaptive") > F.col("r0")).alias("raised"))


_NT = f"CASE WHEN adaptive / r0 <= 1.000001e0 THEN 1 ELSE coalesce(list_filter(range(1, 21), lambda n: {o.weight('n', '1')} <= r0 / adaptive + 1e-9)[1], 20) END"


@query(f"WITH {_HXA} SELECT obs_id, {_r('adaptive / r0 AS ratio')}, CAST({_NT} AS INT) AS ntemp FROM b")
def solve_ntemp(spark, sf_dir):
    ratio = F.col("adaptive") / F.col("r0")
    return _adaptive(spark, sf_dir).select("obs_id", ratio.alias("ratio"), tempering.solve_ntemp(ratio, F.lit(1.0)).cast("int").alias("ntemp"))


@query(f"WITH {_HXA}, n AS (SELECT obs_id, r0, alpha_s, CAST({_NT} AS INT) AS ntemp FROM b), s AS (SELECT *, CAST(unnest(range(1, (SELECT max(ntemp) FROM n) + 1)) AS INT) AS step FROM n) SELECT obs_id, step, step <= ntemp AS active, {_r('CASE WHEN step <= ntemp THEN r0 / ' + o.weight('ntemp', 'step') + ' ELSE 1e30 END AS error')} FROM s")
def atenkf_step_errors(spark, sf_dir):
    n = _adaptive(spark, sf_dir).select("obs_id", "r0", tempering.solve_ntemp(F.col("adaptive") / F.col("r0"), F.lit(1.0)).cast("int").alias("ntemp"))
    rows = n.crossJoin(F.broadcast(n.agg(F.max("ntemp").alias("steps")))).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("steps"))))
    active = F.col("step") <= F.col("ntemp")
    error = F.when(active, F.col("r0") / tempering.step_weight(F.col("ntemp"), F.lit(1.0), F.col("step"))).otherwise(multi_obs.FAR)
    return rows.select("obs_id", "step", active.alias("active"), error.alias("error"))


# Combinations

_SWEEP = {"method": ["TEnKF", "AOEI", "LETKF"], "ntemp": {"start": 1, "stop": 3, "num": 5}, "alpha_s": [1.0, 2.0], "loc_x": 2.0, "loc_y": 2.0, "loc_z": [1.0, 4.0]}


@query("""WITH m(method) AS (VALUES ('TEnKF'), ('AOEI'), ('LETKF')), n(ntemp) AS (SELECT DISTINCT CAST(round_even(1 + i * 0.5e0, 0) AS INT) FROM range(5) r(i)), a(alpha_s) AS (VALUES (1e0), (2e0)), z(lz) AS (VALUES (1e0), (4e0))
SELECT DISTINCT method, CASE WHEN method = 'TEnKF' THEN ntemp ELSE 1 END AS ntemp, alpha_s, 2e0 AS lx, 2e0 AS ly, lz FROM m, n, a, z""")
def combo_grid(spark, sf_dir):
    return combo_ops.combo_table(spark, _SWEEP).drop("combo_id")


# Localisation

_ONE = [("LETKF", 1, 2.0, 2.0, 2.0, 2.0), ("LETKF", 1, 2.0, 1.0, 1.0, 4.0)]
_BASE = f"{o.STATE}, {o.GRID}, {o.SPLIT}, {o.obs()}"


def _combos(spark, rows):
    from ..schema import COMBOS

    return spark.createDataFrame([(n, *c) for n, c in enumerate(rows)], COMBOS)


@query(f"WITH {_BASE}, {o.combos(_ONE)}, {o.PAIRS} SELECT obs_id, combo_id, count(*) AS n_points, count(*) FILTER (WHERE updated) AS n_updated, {_r('sum(rho) AS weights', 'max(d2) AS farthest', 'sum(r0 / greatest(exp(-0.5e0 * d2), 1e-6)) AS errors')} FROM pairs GROUP BY obs_id, combo_id")
def localization_weights(spark, sf_dir):
    obs, *_ = _obs(spark, sf_dir)
    pairs = neighbours.localised_pairs(obs, _combos(spark, _ONE), fx.grid(spark))
    return pairs.groupBy("obs_id", "combo_id").agg(F.count(F.lit(1)).alias("n_points"), F.count_if("updated").alias("n_updated"), F.sum("rho").alias("weights"), F.max("d2").alias("farthest"), F.sum(physics.localised_error(F.col("r0"), F.col("d2"))).alias("errors"))


# Analyses with one observation


def _analysed(spark, sf_dir, rows, steps, stride=1):
    obs, truth, prior = _obs(spark, sf_dir, stride)
    pairs = neighbours.localised_pairs(obs, _combos(spark, rows), fx.grid(spark))
    if any(r[0] == "ATEnKF" for r in rows):  # as many steps as each observation needs; the SQL unrolls the most there can be
        return kernel_steps.analyse(pairs, prior), truth
    return single_obs.analyse(single_obs.with_members(pairs, prior), steps), truth


def _sql_analysed(rows, steps, stride=1):
    return f"{o.STATE}, {o.GRID}, {o.SPLIT}, {o.obs(stride)}, {o.combos(rows)}, {o.PAIRS}, {o.ROWS}, {o.steps(steps)}"


_MEASURES = [f"{a}_{t}{w}" for t in "fa" for a, w in (("rmse", ""), ("spread", ""), ("rmse", "_w"), ("spread", "_w"))]


def _sql_measures(x: str) -> str:
    out = []
    for t in "fa":
        e, s = f"(m{t}_{x} - t_{x})", f"s{t}_{x}"
        out += [f"sqrt(avg({e} * {e})) AS rmse_{t}", f"avg({s}) AS spread_{t}", f"sqrt(sum(rho * {e} * {e}) / sum(rho)) AS rmse_{t}_w", f"sum(rho * {s}) / sum(rho) AS spread_{t}_w"]
    return _r(*out)


def _sql_metrics(last: str) -> str:
    meta = "obs_id, combo_id, any_value(method) AS method, any_value(ntemp) AS ntemp"
    each = " UNION ALL ".join(f"SELECT {meta}, '{x}' AS var, {_sql_measures(x)}, {_r('max(CASE WHEN at_obs THEN ma_ref END) AS hxa_mean', 'any_value(yo) - max(CASE WHEN at_obs THEN ma_ref END) AS dep_a')} FROM cells GROUP BY obs_id, combo_id" for x in (*VARIABLES, "ref"))
    return f"{o.cells(last)} {each}"


def _metrics(df: DataFrame) -> DataFrame:
    return df.select("obs_id", "combo_id", "method", "ntemp", "var", *_MEASURES, "hxa_mean", "dep_a")


@query(f"WITH {_sql_analysed(_ONE[:1], 1)}, {_sql_metrics('a1')}")
def letkf_single_obs(spark, sf_dir):
    rows, truth = _analysed(spark, sf_dir, _ONE[:1], 1)
    return _metrics(single_obs.metrics(single_obs.with_truth(single_obs.moments(rows), truth)))


@query(f"WITH {_sql_analysed(_ONE[:1], 1, 2)} SELECT obs_id, gi, gj, gk, m, {_r(*VARIABLES)} FROM a1")
def letkf_members(spark, sf_dir):
    rows, _ = _analysed(spark, sf_dir, _ONE[:1], 1, 2)
    return rows.select("obs_id", "gi", "gj", "gk", "m", *VARIABLES)


@query(f"WITH {_sql_analysed([_ONE[0], ('TEnKF', 2, 2.0, 2.0, 2.0, 2.0)], 2, 2)} SELECT obs_id, combo_id, gi AS i, gj AS j, gk AS k, m, {_r(*VARIABLES)} FROM a2")
def zone_fields(spark, sf_dir):
    return single_obs.zone_fields(_analysed(spark, sf_dir, [_ONE[0], ("TEnKF", 2, 2.0, 2.0, 2.0, 2.0)], 2, 2)[0])


def _by_method(name, method, ntemp, steps):
    rows = [(method, ntemp, 1.0, 2.0, 2.0, 2.0)]
    sql = f"WITH {_sql_analysed(rows, steps, 2)} SELECT obs_id, gi, gj, gk, {_r('any_value(d2) AS d2', *(f'avg({x}) AS mean_{x}' for x in VARIABLES), *(f'stddev_samp({x}) AS spread_{x}' for x in VARIABLES), f'avg({o.h()}) AS mean_ref')} FROM a{steps} GROUP BY obs_id, gi, gj, gk"

    def run(spark, sf_dir):
        done, _ = _analysed(spark, sf_dir, rows, steps, 2)
        cells = done.groupBy("obs_id", "gi", "gj", "gk")
        return cells.agg(F.first("d2").alias("d2"), *(F.avg(x).alias(f"mean_{x}") for x in VARIABLES), *(F.stddev_samp(x).alias(f"spread_{x}") for x in VARIABLES), F.avg(physics.h()).alias("mean_ref"))

    run.__name__ = name
    query(sql)(run)


_by_method("tenkf_nt2", "TEnKF", 2, 2)
_by_method("tenkf_nt3", "TEnKF", 3, 3)
_by_method("aoei_update_single", "AOEI", 1, 1)
_by_method("atenkf_single", "ATEnKF", 1, tempering.MOST_STEPS)
_by_method("taoei_single", "TAOEI", 2, 2)

_MANY = [("TEnKF", 1, 2.0, 2.0, 2.0, 2.0), ("TEnKF", 2, 2.0, 2.0, 2.0, 2.0), ("AOEI", 1, 2.0, 2.0, 2.0, 2.0), ("TAOEI", 2, 1.0, 2.0, 2.0, 1.0)]


@query(f"WITH {_sql_analysed(_MANY, 2, 2)}, {_sql_metrics('a2')}")
def sweep_metrics(spark, sf_dir):
    obs, truth, prior = _obs(spark, sf_dir, 2)
    return _metrics(single_obs.sweep(obs, _combos(spark, _MANY), fx.grid(spark), prior, truth, steps=2))


@query(f"WITH {_sql_analysed([('LETKF', 1, 2.0, 1.0, 1.0, 1.0)], 1).replace(f'{o.STATE}, {o.GRID}', o.DOMAIN)}, {_sql_metrics('a1')}")
def domain_sweep(spark, sf_dir):
    """An analysis of its own for every point of a domain that grows with the input."""
    state, grid = fx.domain(spark, sf_dir)
    truth, prior = ensemble.truth_of(state, fx.TRUTH), ensemble.prior_of(state, fx.TRUTH, fx.PRIOR)
    obs = ensemble.observations(truth, prior, grid, r0=fx.R0)
    return _metrics(single_obs.sweep(obs, _combos(spark, [("LETKF", 1, 2.0, 1.0, 1.0, 1.0)]), grid, prior, truth, steps=1))


def _sql_zone() -> str:
    here = lambda c: f"max(CASE WHEN at_obs THEN {c} END)"
    out = ["sum(rho) AS loc_weights_sum", "any_value(yo) AS yo"]
    out += [f"{here(f'{a}{t}_ref')} AS {n}_{t}_obs" for t in "fa" for a, n in (("m", "hx_mean"), ("s", "spread"))]
    for x in VARIABLES:
        for t in "fa":
            e, s = f"(m{t}_{x} - t_{x})", f"s{t}_{x}"
            out += [
                f"sqrt(sum(rho * {e} * {e}) / sum(rho)) AS rmse_{t}_w_{x}", f"sum(rho * {e}) / sum(rho) AS bias_{t}_w_{x}", f"sqrt(sum(rho * {s} * {s}) / sum(rho)) AS spread_{t}_w_{x}",
                f"sqrt(avg({e} * {e})) AS rmse_{t}_u_{x}", f"avg({e}) AS bias_{t}_u_{x}", f"sqrt(avg({s} * {s})) AS spread_{t}_u_{x}", f"{here(f'm{t}_{x}')} AS x{t}_mean_{x}",
            ]
        out.append(f"{here(f't_{x}')} AS truth_{x}")
    out += [f"any_value(yo) - {here('mf_ref')} AS dep_b", f"any_value(yo) - {here('ma_ref')} AS dep_a", f"{here('ma_ref')} - {here('mf_ref')} AS inc_obs"]
    return f"{o.cells('a1')} SELECT obs_id, combo_id, count(*) AS n_updated, {_r(*out)} FROM cells GROUP BY obs_id, combo_id"


@query(f"WITH {_sql_analysed(_ONE, 1, 2)}, {_sql_zone()}")
def single_obs_metrics(spark, sf_dir):
    rows, truth = _analysed(spark, sf_dir, _ONE, 1, 2)
    return single_obs.zone_statistics(single_obs.with_truth(single_obs.moments(rows), truth))


def _sql_zone_obs() -> str:
    out = [f"{f} AS {n}_{t}_obs_{w}" for t in "fa" for w, n, f in (
        ("w", "rmse", f"sqrt(sum(rho * e{t} * e{t}) / sum(rho))"), ("w", "bias", f"sum(rho * e{t}) / sum(rho)"), ("u", "rmse", f"sqrt(avg(e{t} * e{t}))"), ("u", "bias", f"avg(e{t})"))]
    errors = ", ".join(f"{o.h(f'm{t}_')} - t_ref AS e{t}" for t in "fa")
    return f"{o.cells('a1')}, errors AS (SELECT *, {errors} FROM cells) SELECT obs_id, combo_id, any_value(gi) FILTER (WHERE at_obs) AS i0, any_value(gj) FILTER (WHERE at_obs) AS j0, any_value(gk) FILTER (WHERE at_obs) AS k0, min(gk) AS k_first, max(gk) AS k_last, {_r(*out)} FROM errors GROUP BY obs_id, combo_id"


@query(f"WITH {_sql_analysed(_ONE, 1, 2)}, {_sql_zone_obs()}")
def single_obs_space_metrics(spark, sf_dir):
    rows, truth = _analysed(spark, sf_dir, _ONE, 1, 2)
    return single_obs.zone_observation_statistics(single_obs.with_truth(single_obs.moments(rows), truth))


@query(f"WITH {_sql_analysed([('AOEI', 1, 2.0, 2.0, 2.0, 2.0)], 1)} SELECT combo_id, count(*) AS n_obs, count(*) FILTER (WHERE raised) AS n_raised FROM (SELECT obs_id, combo_id, any_value(r_step) > any_value(r0) + 1e-6 AS raised FROM a1 WHERE at_obs GROUP BY obs_id, combo_id) GROUP BY combo_id")
def aoei_activity(spark, sf_dir):
    return single_obs.raised_errors(_analysed(spark, sf_dir, [("AOEI", 1, 2.0, 2.0, 2.0, 2.0)], 1)[0])


# Analyses with many observations


def _multi(spark, sf_dir, method, ntemp=1):
    obs, truth, prior = _obs(spark, sf_dir, 2)
    done = multi_obs.assimilate(prior, obs, fx.grid(spark), method=method, ntemp=ntemp, alpha_s=1.0, scales=(2.0, 2.0, 2.0))
    return done.state, truth


def _one_observation(name, method, ntemp, steps):
    """The kernel of many observations with one of them, whose closed form SQL can express."""
    rows = [(method, ntemp, 1.0, 2.0, 2.0, 2.0)]
    first = f"{o.obs(2).replace('obs AS (', 'every_obs AS (', 1)}, obs AS (SELECT * FROM every_obs WHERE obs_id = (SELECT min(obs_id) FROM every_obs))"
    sql = f"WITH {o.STATE}, {o.GRID}, {o.SPLIT}, {first}, {o.combos(rows)}, {o.PAIRS}, {o.ROWS}, {o.steps(steps)} SELECT gi AS i, gj AS j, gk AS k, m, {_r(*VARIABLES)} FROM a{steps} WHERE updated"

    def run(spark, sf_dir):
        obs, _, prior = _obs(spark, sf_dir, 2)
        obs = obs.join(F.broadcast(obs.agg(F.min("obs_id").alias("obs_id"))), "obs_id")
        done = multi_obs.assimilate(prior, obs, fx.grid(spark), method=method, ntemp=ntemp, alpha_s=1.0, scales=(2.0, 2.0, 2.0)).state
        near = neighbours.localised_pairs(obs, _combos(spark, rows), fx.grid(spark)).where("updated").select(*(F.col(f"g{a}").alias(a) for a in "ijk"))
        return done.join(near, ["i", "j", "k"]).select("i", "j", "k", "m", *VARIABLES)

    run.__name__ = name
    query(sql)(run)


_one_observation("multi_obs_kernel_letkf", "LETKF", 1, 1)
_one_observation("multi_obs_kernel_tenkf", "TEnKF", 3, 3)
_one_observation("multi_obs_kernel_aoei", "AOEI", 1, 1)
_one_observation("multi_obs_kernel_taoei", "TAOEI", 2, 2)


_AOEI = "greatest(r0, pow(yo - y_mean, 2) - y_var)"
_ALL = f"{o.STATE}, {o.GRID}, {o.SPLIT}, {o.obs(2)}, {o.combos(_ONE[:1])}"
_FIELDS = [c for x in VARIABLES for c in (x, f"s_{x}")]


@query(f"WITH RECURSIVE {_ALL}, {o.gain()} SELECT i, j, k, {_r(*_FIELDS)} FROM analysed")
def letkf_multi_obs(spark, sf_dir):
    return verification.means(_multi(spark, sf_dir, "LETKF")[0])


@query(f"WITH RECURSIVE {_ALL}, {o.gain(_AOEI)} SELECT i, j, k, {_r(*_FIELDS)} FROM analysed")
def aoei_multi_obs(spark, sf_dir):
    return verification.means(_multi(spark, sf_dir, "AOEI")[0])


def _sql_scores() -> str:
    e = "(mean - truth)"
    rows = o.unpivot("SELECT '{x}' AS var, a.{x} AS mean, a.s_{x} AS spread, b.{x} AS truth FROM analysed a JOIN truth b USING (i, j, k)", VARIABLES)
    return f"SELECT var, {_r(f'sqrt(avg({e} * {e})) AS rmse', f'avg({e}) AS bias', 'avg(spread) AS spread')} FROM ({rows}) GROUP BY var"


@query(f"WITH RECURSIVE {_ALL}, {o.gain(_AOEI)} {_sql_scores()}")
def aoei_multi_obs_metrics(spark, sf_dir):
    done, truth = _multi(spark, sf_dir, "AOEI")
    return verification.global_metrics(verification.by_variable(done, truth))


_NEAR = [("LETKF", 1, 2.0, 1.2, 1.2, 1.2)]


@query(f"WITH RECURSIVE {o.DOMAIN}, {o.SPLIT}, {o.obs(2)}, {o.combos(_NEAR)}, {o.gain()} SELECT i, j, k, {_r(*_FIELDS)} FROM analysed")
def domain_letkf(spark, sf_dir):
    """All observations of a domain that grows with the input."""
    state, grid = fx.domain(spark, sf_dir)
    truth, prior = ensemble.truth_of(state, fx.TRUTH), ensemble.prior_of(state, fx.TRUTH, fx.PRIOR)
    obs = ensemble.observations(truth, prior, grid, stride=2, r0=fx.R0)
    return verification.means(multi_obs.assimilate(prior, obs, grid, method="LETKF", scales=(1.2, 1.2, 1.2)).state)


_INFLATION = 1.2
_FIRST = f"{o.STATE}, {o.GRID}, {o.SPLIT}, {o.obs(2).replace('obs AS (', 'every_obs AS (', 1)}, obs AS (SELECT * FROM every_obs WHERE obs_id = (SELECT min(obs_id) FROM every_obs)), {o.combos(_ONE[:1])}, {o.PAIRS}"
_INFLATED = f"""{_FIRST}, members AS (
  SELECT gi, gj, gk, yo, r0 / greatest(exp(-0.5e0 * d2), 1e-6) AS r, p.*, max(CASE WHEN pairs.i = gi AND pairs.j = gj AND pairs.k = gk THEN {o.h("p.")} END) OVER (PARTITION BY p.m) AS y
  FROM pairs JOIN prior p ON p.i = gi AND p.j = gj AND p.k = gk WHERE updated),
cell AS (SELECT gi AS i, gj AS j, gk AS k, any_value(r) AS r, any_value(yo) - avg(y) AS d, avg(y) AS y_mean, var_samp(y) AS y_var, count(*) AS n, {", ".join(f"covar_samp({x}, y) AS c_{x}, avg({x}) AS m_{x}, var_samp({x}) AS v_{x}" for x in VARIABLES)} FROM members GROUP BY gi, gj, gk)"""


def _first_observation(spark, sf_dir):
    obs, _, prior = _obs(spark, sf_dir, 2)
    obs = obs.join(F.broadcast(obs.agg(F.min("obs_id").alias("obs_id"))), "obs_id")
    near = neighbours.localised_pairs(obs, _combos(spark, _ONE[:1]), fx.grid(spark)).where("updated").select(*(F.col(f"g{a}").alias(a) for a in "ijk"))
    return multi_obs.observed(prior, obs).withColumn("r", F.col("r0")), prior, near


def _sql_inflated(x: str) -> str:
    p = f"{_INFLATION}e0"
    return f"m_{x} + {p} * c_{x} * d / ({p} * y_var + r) + sqrt({p}) * ({x} - m_{x} + c_{x} / y_var * (y - y_mean) * (sqrt(r / (r + {p} * y_var)) - 1)) AS {x}"


@query(f"WITH {_INFLATED}, rows AS (SELECT c.i, c.j, c.k, p.m, {', '.join(_sql_inflated(x) for x in VARIABLES)} FROM members p JOIN (SELECT * EXCLUDE (r) FROM cell) c ON p.gi = c.i AND p.gj = c.j AND p.gk = c.k) SELECT i, j, k, m, {_r(*VARIABLES)} FROM rows")
def inflated_letkf(spark, sf_dir):
    obs, prior, near = _first_observation(spark, sf_dir)
    return multi_obs.letkf(prior, obs, fx.grid(spark), scales=(2.0, 2.0, 2.0), inflation=_INFLATION).join(near, ["i", "j", "k"]).select("i", "j", "k", "m", *VARIABLES)


@query(f"WITH {_INFLATED} SELECT i, j, k, {_r(f'{_INFLATION}e0 + {_INFLATION}e0 * r / ((n - 1) * (r + {_INFLATION}e0 * y_var)) AS trace', *(f'sqrt({_INFLATION}e0 * v_{x} - pow({_INFLATION}e0 * c_{x}, 2) / ({_INFLATION}e0 * y_var + r)) AS s_{x}' for x in VARIABLES))} FROM cell")
def analysis_covariance(spark, sf_dir):
    """Spreads from the covariance in the space of the members, and its trace."""
    obs, prior, near = _first_observation(spark, sf_dir)
    done = multi_obs.covariance(prior, obs, fx.grid(spark), scales=(2.0, 2.0, 2.0), inflation=_INFLATION).join(near, ["i", "j", "k"])
    n = F.size("members")
    trace = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, l: s + F.get("covariance", l * (n + 1)))
    return done.select("i", "j", "k", trace.alias("trace"), *(f"s_{x}" for x in VARIABLES))


@query()
def multi_obs_analysis_metrics(spark, sf_dir):
    out = None
    for method, ntemp in (("LETKF", 1), ("TEnKF", 2), ("AOEI", 1)):
        done, truth = _multi(spark, sf_dir, method, ntemp)
        rows = verification.global_metrics(verification.by_variable(done, truth)).withColumn("method", F.lit(method))
        out = rows if out is None else out.unionByName(rows)
    return out


_MEANS = f"""{o.STATE}, {o.SPLIT}, mean AS (SELECT i, j, k, {", ".join(f"avg({x}) AS {x}, stddev_samp({x}) AS s_{x}" for x in VARIABLES)} FROM prior GROUP BY i, j, k),
rows AS ({o.unpivot("SELECT i, j, k, '{x}' AS var, a.{x} AS mean, a.s_{x} AS spread, b.{x} AS truth FROM mean a JOIN truth b USING (i, j, k)", VARIABLES)})"""
_E = "(mean - truth)"


def _rows(spark, sf_dir):
    _, truth, prior = _split(spark, sf_dir)
    return verification.by_variable(prior, truth)


@query(f"WITH {_MEANS} SELECT var, {_r(f'sqrt(avg({_E} * {_E})) AS rmse', f'avg({_E}) AS bias', 'avg(spread) AS spread')} FROM rows GROUP BY var")
def multi_obs_global_metrics(spark, sf_dir):
    return verification.global_metrics(_rows(spark, sf_dir))


@query(f"WITH {_MEANS} SELECT i, j, k, {_r(f'sqrt(avg({_E} * {_E})) AS rmse', f'avg({_E}) AS bias', 'avg(spread) AS spread')} FROM rows GROUP BY i, j, k")
def multi_obs_point_metrics(spark, sf_dir):
    return verification.point_metrics(_rows(spark, sf_dir))


@query(f"WITH {_MEANS} SELECT var, k, {_r(f'sqrt(avg({_E} * {_E})) AS rmse', 'avg(spread) AS spread')} FROM rows GROUP BY var, k")
def vertical_profiles(spark, sf_dir):
    return verification.profiles(_rows(spark, sf_dir))


@query(f"WITH {_MEANS} SELECT var, {_r(f'sqrt(avg(CASE WHEN truth > 1e-3 THEN {_E} * {_E} END)) AS rmse')}, count(*) FILTER (WHERE truth > 1e-3) AS n FROM rows GROUP BY var")
def conditional_rmse(spark, sf_dir):
    return verification.conditional(_rows(spark, sf_dir), 1e-3)


_Y = f"y AS (SELECT *, {o.h()} AS y FROM state)"


@query(f"WITH {o.STATE}, {_Y} SELECT 'z' AS axis, i AS a, j AS b, {_r('max(y) AS most')} FROM y GROUP BY i, j UNION ALL SELECT 'y', i, k, {_r('max(y) AS most')} FROM y GROUP BY i, k UNION ALL SELECT 'x', j, k, {_r('max(y) AS most')} FROM y GROUP BY j, k")
def max_projections(spark, sf_dir):
    return verification.projections(ensemble.with_reflectivity(fx.state(spark, sf_dir)), "y")


@query(f"WITH {_MEANS}, e AS (SELECT var, CASE WHEN k = 0 THEN 'low' WHEN k = 1 THEN 'middle' ELSE 'high' END AS method, sqrt(avg({_E} * {_E})) AS rmse FROM rows GROUP BY ALL) SELECT var, a.method, {_r('100 * (a.rmse - b.rmse) / nullif(b.rmse, 0) AS change')} FROM e a JOIN (SELECT var, rmse FROM e WHERE method = 'low') b USING (var)")
def rmse_change_vs_baseline(spark, sf_dir):
    level = F.when(F.col("k") == 0, "low").when(F.col("k") == 1, "middle").otherwise("high")
    errors = _rows(spark, sf_dir).groupBy("var", level.alias("method")).agg(stats.rmse(F.col("mean") - F.col("truth")).alias("rmse"))
    return verification.change_of_rmse(errors, "low")


@query(f"WITH {_MEANS}, e AS (SELECT var, i, j, sum(CASE WHEN k = 1 THEN {_E} END) AS after, sum(CASE WHEN k = 0 THEN {_E} END) AS before FROM rows GROUP BY var, i, j), l AS (SELECT *, 0.01e0 * max(abs(before)) OVER (PARTITION BY var) AS least FROM e) SELECT var, i, j, {_r('CASE WHEN abs(before) >= least THEN least(greatest(100 * (abs(after) - abs(before)) / abs(before), -100e0), 100e0) END AS change')} FROM l")
def pct_improvement(spark, sf_dir):
    from pyspark.sql import Window

    e = F.col("mean") - F.col("truth")
    rows = _rows(spark, sf_dir).groupBy("var", "i", "j").agg(F.sum(F.when(F.col("k") == 1, e)).alias("after"), F.sum(F.when(F.col("k") == 0, e)).alias("before"))
    least = F.max(F.abs("before")).over(Window.partitionBy("var")) * 0.01
    return rows.withColumn("least", least).select("var", "i", "j", physics.percent_change(F.col("after"), F.col("before"), F.col("least")).alias("change"))


@query(f"WITH {_HX}, w AS (SELECT obs_id, exp(-0.5e0 * pow(yo - y, 2) / 50e0) AS w FROM hx), s AS (SELECT obs_id, sum(w) + 1e-12 AS s FROM w GROUP BY obs_id) SELECT obs_id, {_r('1 / sum(pow(w / s, 2)) AS ess')} FROM w JOIN s USING (obs_id) GROUP BY obs_id")
def ess(spark, sf_dir):
    d = fx.hx(spark, sf_dir).join(fx.hx_obs(spark, sf_dir), "obs_id").select("obs_id", (F.col("yo") - F.col("y")).alias("d"))
    return verification.effective_size(d, 50.0)


_D = "d AS (SELECT event_type, (value - 50) * 0.4e0 AS d FROM events)"


@query(f"WITH {_D}, b AS (SELECT event_type, least(CAST(floor((d + 20) / 0.8e0) AS INT), 49) AS bin FROM d WHERE d BETWEEN -20 AND 20), c AS (SELECT event_type, bin, count(*) AS n FROM b GROUP BY ALL) SELECT event_type, bin, n, {_r('n / (sum(n) OVER (PARTITION BY event_type) * 0.8e0) AS density')} FROM c")
def departure_histogram(spark, sf_dir):
    return verification.histogram(fx.departures(spark, sf_dir), F.col("d"), -20.0, 20.0, 50, "event_type", density=True)


@query(f"WITH {_D} SELECT event_type, count(d) AS n, {_r('avg(d) AS mean', 'stddev_pop(d) AS std', 'min(d) AS least', 'max(d) AS most', 'median(d) AS median', 'avg((abs(d) > 10)::INT) AS large_share')}, count(*) FILTER (WHERE abs(d) > 10) AS n_large FROM d GROUP BY event_type")
def innovation_stats(spark, sf_dir):
    return verification.innovations(fx.departures(spark, sf_dir), "event_type")


def _sql_hexbin() -> str:
    sx, sy = 50 / 17, 120 / 9
    return f"""WITH {_HX}, p AS (SELECT abs(yo - y) AS x, abs(yo - y) - abs(yo - avg(y) OVER (PARTITION BY obs_id)) AS z FROM hx),
ab AS (SELECT x / {sx!r}::DOUBLE AS a, (z + 70) / {sy!r}::DOUBLE AS b FROM p WHERE x BETWEEN 0 AND 50 AND z BETWEEN -70 AND 50),
n AS (SELECT *, pow(a - round_even(a, 0), 2) + 3 * pow(b - round_even(b, 0), 2) < pow(a - floor(a) - 0.5e0, 2) + 3 * pow(b - floor(b) - 0.5e0, 2) AS near FROM ab)
SELECT {_r(f"CASE WHEN near THEN round_even(a, 0) ELSE floor(a) + 0.5e0 END * {sx!r}::DOUBLE AS cx", f"CASE WHEN near THEN round_even(b, 0) ELSE floor(b) + 0.5e0 END * {sy!r}::DOUBLE - 70 AS cy")}, count(*) AS n FROM n GROUP BY 1, 2"""


@query(_sql_hexbin())
def hexbin(spark, sf_dir):
    from pyspark.sql import Window

    d = fx.hx(spark, sf_dir).join(fx.hx_obs(spark, sf_dir), "obs_id")
    x = F.abs(F.col("yo") - F.col("y"))
    z = x - F.abs(F.col("yo") - F.avg("y").over(Window.partitionBy("obs_id")))
    return verification.hexbin(d.select(x.alias("x"), z.alias("z")), "x", "z", 17, (0.0, 50.0, -70.0, 50.0))


_POINTS = f"{o.STATE}, {o.SPLIT}, pts AS (SELECT i, j, k, yo, yo - m AS d, s AS spread FROM (SELECT i, j, k, {o.h()} AS yo FROM truth) JOIN (SELECT i, j, k, avg({o.h()}) AS m, stddev_pop({o.h()}) AS s FROM prior GROUP BY i, j, k) USING (i, j, k))"


def _departure_points(spark, sf_dir):
    _, truth, prior = _split(spark, sf_dir)
    y = ensemble.with_reflectivity(prior).groupBy(*POINT).agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("spread"))
    t = ensemble.with_reflectivity(truth).select(*POINT, F.col("y").alias("yo"))
    return t.join(y, list(POINT)).select(*POINT, "yo", (F.col("yo") - F.col("mean")).alias("d"), "spread")


@query(f"WITH {_POINTS}, s AS ({' UNION ALL '.join(f'SELECT {n!r} AS kind, *, {s} AS score FROM pts' for n, s in (('A', '-abs(d) + CASE WHEN yo > 30 THEN 5 ELSE 0 END'), ('B', 'd'), ('C', '-d')))}) SELECT kind, i, j, k, {_r('score')} FROM s WHERE yo > 5 AND spread > 1 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, i, j, k) = 1")
def candidate_points(spark, sf_dir):
    return ensemble.candidates(_departure_points(spark, sf_dir))


@query(f"WITH {_POINTS} SELECT i, j, k, {_r('d / greatest(spread, 0.1e0) AS normalised', '(1 - abs(d - spread) / greatest(abs(d), 1e-6)) * 100 AS reduction')} FROM pts")
def innovation_diagnostics(spark, sf_dir):
    d, s = F.col("d"), F.col("spread")
    return _departure_points(spark, sf_dir).select(*POINT, physics.normalised_innovation(d, s).alias("normalised"), physics.innovation_reduction(d, d - s).alias("reduction"))


@query(f"WITH {o.STATE}, {_Y}, f AS (SELECT i, j, max(y) AS y FROM y GROUP BY i, j) SELECT coalesce(greatest(min(i) FILTER (WHERE y > 38) - 1, min(i)), min(i)) - 0.5e0 AS a_min, coalesce(least(max(i) FILTER (WHERE y > 38) + 1, max(i)), max(i)) + 0.5e0 AS a_max, coalesce(greatest(min(j) FILTER (WHERE y > 38) - 1, min(j)), min(j)) - 0.5e0 AS b_min, coalesce(least(max(j) FILTER (WHERE y > 38) + 1, max(j)), max(j)) + 0.5e0 AS b_max FROM f")
def tight_bbox(spark, sf_dir):
    field = ensemble.with_reflectivity(fx.state(spark, sf_dir)).groupBy("i", "j").agg(F.max("y").alias("y"))
    return verification.tight_box(field, "i", "j", "y", threshold=38.0, pad=1)


# Geometry

_LATLON = "ll AS (SELECT DISTINCT CAST(c_custkey % 16 AS INT) AS j, CAST((c_custkey // 16) % 25 AS INT) AS i FROM customer), g AS (SELECT j, i, -35e0 + j * 0.02e0 + i * 0.001e0 AS lat, -60e0 + i * 0.025e0 - j * 0.002e0 AS lon FROM ll)"
_TARGETS = [("a", -34.9, -59.8), ("b", -34.77, -59.5), ("c", -36.0, -61.0)]


@query(f"WITH {_LATLON}, t(name, tlat, tlon) AS (VALUES {', '.join(f'({n!r}, {a!r}::DOUBLE, {b!r}::DOUBLE)' for n, a, b in _TARGETS)}), s AS (SELECT name, j, i, pow(lat - tlat, 2) + pow(lon - tlon, 2) AS d2 FROM g, t) SELECT name, j, i, {_r('d2')} FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY d2, j, i) = 1")
def nearest_grid_point(spark, sf_dir):
    return neighbours.nearest(fx.latlon(spark, sf_dir), spark.createDataFrame(_TARGETS, "name string, lat double, lon double"))


@query(f"WITH {_LATLON}, c AS (SELECT lat AS lat0, lon AS lon0 FROM g WHERE i = 0 AND j = 0) SELECT i, j, CAST(k AS INT) AS k, {_r('6371e0 * radians(lon - lon0) * cos((radians(lat0) + radians(lat)) / 2) AS x_km', '6371e0 * (radians(lat) - radians(lat0)) AS y_km', 'k * 250e0 / 1000e0 AS z_km')} FROM g, c, range(3) z(k)")
def pos_km(spark, sf_dir):
    points = fx.latlon(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("z_m", F.col("k") * 250.0)
    return neighbours.positions(points)


# Snapshots


@query("WITH s AS (SELECT date_trunc('hour', ts) AS ts_hour, event_type, sum(value) AS total FROM events GROUP BY 1, 2) SELECT strftime(ts_hour, '%Y-%m-%d %H') AS hour, event_type, " + _r("total - lag(total) OVER (PARTITION BY event_type ORDER BY ts_hour) AS accumulated") + " FROM s")
def snapshot_difference(spark, sf_dir):
    s = fx.snapshots(spark, sf_dir).select(F.col("event_type").alias("m"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("ts_hour").alias("ts"), F.col("total").alias("rain"))
    return ensemble.snapshot_difference(s).select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.col("m").alias("event_type"), "accumulated")


@query("""WITH h AS (SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL 1 HOUR)) AS ts_hour), e AS (SELECT DISTINCT event_type FROM events), s AS (SELECT date_trunc('hour', ts) AS ts_hour, event_type, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT strftime(ts_hour, '%Y-%m-%d %H') AS hour, event_type, """ + _r("total") + """, total IS NULL AS missing FROM h CROSS JOIN e LEFT JOIN s USING (ts_hour, event_type)""")
def missing_snapshots(spark, sf_dir):
    from ..sources import extract

    rows = fx.snapshots(spark, sf_dir)
    hours = extract.valid_times(spark, "2024-01-01 00:00:00", "2024-01-02 23:00:00", "1 hour")
    lattice = hours.select(F.col("valid_time").alias("ts_hour")).crossJoin(F.broadcast(rows.select("event_type").distinct()))
    out = lattice.join(rows, ["ts_hour", "event_type"], "left")
    return out.select(F.date_format("ts_hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "total", F.col("total").isNull().alias("missing"))


# Slices and comparisons


@query(f"WITH {o.STATE}, {_Y} SELECT k, {_r('avg(y) FILTER (WHERE m <> 3) AS mean', 'stddev_pop(y) FILTER (WHERE m <> 3) AS std', 'min(y) FILTER (WHERE m <> 3) AS least', 'max(y) FILTER (WHERE m <> 3) AS most', 'max(y) FILTER (WHERE m = 3) AS truth')} FROM y WHERE i = 1 AND j = 2 GROUP BY k")
def column_profile(spark, sf_dir):
    y = ensemble.with_reflectivity(fx.state(spark, sf_dir))
    return slices.column_profile(y.where(F.col("m") != fx.TRUTH), ensemble.truth_of(y, fx.TRUTH), "y", 1, 2)


@query(f"WITH {o.STATE}, {_Y} SELECT i, j, {_r('CASE WHEN y >= 38 THEN y END AS y', 'qr * 1000 AS qr')} FROM y WHERE m = 3 AND k = (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY k) AS n FROM (SELECT DISTINCT k FROM y)) WHERE n = 2)")
def cross_section(spark, sf_dir):
    y = ensemble.truth_of(ensemble.with_reflectivity(fx.state(spark, sf_dir)), fx.TRUTH)
    level = slices.scaled(slices.nth_level(y, "k", 1), {"qr": 1000.0})
    return level.select("i", "j", slices.masked_below(F.col("y"), 38.0).alias("y"), "qr")


@query(f"WITH {_D}, e AS (SELECT event_type, min(d) AS lo, max(d) AS hi FROM d GROUP BY 1) SELECT event_type, least(CAST(floor((d - lo) / ((hi - lo) / 60)) AS INT), 59) AS bin, count(*) AS n FROM d JOIN e USING (event_type) GROUP BY 1, 2")
def departure_range_histogram(spark, sf_dir):
    return slices.range_histogram(fx.departures(spark, sf_dir), "d", 60, "event_type")


@query(f"WITH {o.STATE} SELECT k, count(*) AS n, {_r('avg(t) AS t')} FROM state WHERE k <> 1 GROUP BY k")
def live_levels(spark, sf_dir):
    state = fx.state(spark, sf_dir)
    dead = state.withColumn("t", F.when(F.col("k") == 1, F.lit(float("nan"))).otherwise(F.col("t")))
    return ensemble.live_levels(dead, "t").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("t"))


@query(f"WITH {o.STATE}, {_Y} SELECT i, j, {_r('avg(y) FILTER (WHERE m <> 0) AS mean', 'max(y) FILTER (WHERE m <> 0) AS most')}, count(*) FILTER (WHERE m <> 0) AS n FROM y GROUP BY i, j")
def number_skipping_stats(spark, sf_dir):
    y = ensemble.with_reflectivity(fx.state(spark, sf_dir)).withColumn("y", F.when(F.col("m") == 0, F.lit(float("nan"))).otherwise(F.col("y")))
    return y.groupBy("i", "j").agg(*(c.alias(n) for n, c in slices.skipping("y").items()))


@query(f"WITH {_LATLON}, s AS (SELECT * FROM (VALUES ('low', -34.95e0, -59.9e0), ('high', -34.8e0, -59.6e0)) t(name, tlat, tlon)), b AS (SELECT name, j, i FROM g, s QUALIFY row_number() OVER (PARTITION BY name ORDER BY pow(lat - tlat, 2) + pow(lon - tlon, 2), j, i) = 1) SELECT max(j) FILTER (WHERE name = 'low') AS j0, max(j + 1) FILTER (WHERE name = 'high') AS j1, max(i) FILTER (WHERE name = 'low') AS i0, max(i + 1) FILTER (WHERE name = 'high') AS i1 FROM b")
def bounding_box(spark, sf_dir):
    return neighbours.bounding_box(fx.latlon(spark, sf_dir), -34.95, -59.9, -34.8, -59.6)


@query(f"WITH {_sql_analysed(_MANY[:2], 2, 2)}, {_sql_metrics('a2').replace('SELECT obs_id, combo_id', 'SELECT obs_id, combo_id', 1).replace(' SELECT obs_id, combo_id, any_value(method)', ', r AS (SELECT obs_id, combo_id, any_value(method)', 1)}) SELECT obs_id, var, any_value(rmse_a) FILTER (WHERE ntemp = 1) AS \"1\", any_value(rmse_a) FILTER (WHERE ntemp = 2) AS \"2\" FROM r GROUP BY obs_id, var")
def experiment_comparison(spark, sf_dir):
    obs, truth, prior = _obs(spark, sf_dir, 2)
    rows = single_obs.sweep(obs, _combos(spark, _MANY[:2]), fx.grid(spark), prior, truth, steps=2)
    return slices.pivoted(rows, ["obs_id", "var"], "ntemp", [1, 2], "rmse_a")


@query(f"WITH {o.STATE}, {_Y}, t AS (SELECT * FROM y WHERE m = 3) SELECT 'x' AS plane, j AS a, k AS b, {_r('y')} FROM t WHERE i = 1 UNION ALL SELECT 'y', i, k, {_r('y')} FROM t WHERE j = 2 UNION ALL SELECT 'z', i, j, {_r('y')} FROM t WHERE k = 1")
def plane_sections(spark, sf_dir):
    """A section along each axis."""
    y = ensemble.truth_of(ensemble.with_reflectivity(fx.state(spark, sf_dir)), fx.TRUTH)
    parts = [slices.plane(y, **{axis: at}).select(F.lit(name).alias("plane"), F.col(a).alias("a"), F.col(b).alias("b"), "y") for name, axis, at, a, b in (("x", "i", 1, "j", "k"), ("y", "j", 2, "i", "k"), ("z", "k", 1, "i", "j"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT l_linenumber, count(nullif(l_discount, 0)) AS n, {_r('avg(nullif(l_discount, 0)) AS mean', 'min(nullif(l_tax, 0)) AS least')} FROM lineitem GROUP BY l_linenumber")
def zeros_left_out(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select("l_linenumber", slices.without_zero(F.col("l_discount")).alias("d"), slices.without_zero(F.col("l_tax")).alias("t"))
    return rows.groupBy("l_linenumber").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.min("t").alias("least"))


_QC = [(e, t, m) for e in (False, True) for t in (False, True) for m in ("and", "or") if m == "and" or (e and t)]


def _sql_qc() -> str:
    parts = []
    for e, t, m in _QC:
        tests = [*(["most >= 33"] if e else []), *(["tr.y >= 33"] if t else [])]
        name = "none" if not tests else f"ET_{m}" if len(tests) == 2 else "E" if e else "T"
        parts.append(f"SELECT '{name}' AS code, count(*) FILTER (WHERE {f' {m} '.join(tests) or 'TRUE'}) AS n FROM seen")
    return f"WITH {o.STATE}, {o.SPLIT}, tr AS (SELECT *, {o.h()} AS y FROM truth), seen AS (SELECT * FROM tr JOIN (SELECT i, j, k, max({o.h()}) AS most FROM prior GROUP BY i, j, k) USING (i, j, k)) {' UNION ALL '.join(parts)}".replace("tr.y >=", "y >=")


@query(_sql_qc())
def quality_control_codes(spark, sf_dir):
    """Observations that each setting of quality control lets pass, by its code."""
    _, truth, prior = _split(spark, sf_dir)
    out = None
    for e, t, m in _QC:
        obs = ensemble.observations(truth, prior, fx.grid(spark), dbz_min=33.0, filter_ensemble=e, filter_truth=t, mode=m)
        part = obs.agg(F.count(F.lit(1)).alias("n")).select(F.lit(slices.qc_code(e, t, m)).alias("code"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_BASE}, {o.combos(_ONE)}, {o.PAIRS} SELECT obs_id, combo_id, gi, gj, gk, {_r('d2', 'rho')} FROM (SELECT p.*, g.z_km AS gz FROM pairs p JOIN grid g ON g.i = gi AND g.j = gj AND g.k = gk) WHERE abs(gi - i) <= ceil(0.5e0 * lx / 2) AND abs(gj - j) <= ceil(0.5e0 * ly / 2) AND abs(gz - z_km) <= 0.5e0 * lz")
def subdomain_box(spark, sf_dir):
    """Pairs within an index box about each observation, of half a scale."""
    obs, *_ = _obs(spark, sf_dir)
    grid = fx.grid(spark)
    return neighbours.in_box(neighbours.localised_pairs(obs, _combos(spark, _ONE), grid), grid, 0.5).select("obs_id", "combo_id", "gi", "gj", "gk", "d2", "rho")
