"""Analyses against solutions written independently with numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat.functions import physics
from cirrostrat.operators import multi_obs, neighbours, single_obs
from cirrostrat.plans import catalog, fixtures, runner
from cirrostrat.schema import COMBOS, VARIABLES
from tests.test_physics import reflectivity

N, NE = 5, 7


@pytest.fixture(scope="module")
def domain(spark):
    rng = np.random.default_rng(5)
    x = np.zeros((N, N, 2, NE + 1, len(VARIABLES)))
    for v, (mean, spread) in enumerate(((1e-3, 4e-4), (1e-3, 4e-4), (5e-4, 2e-4), (272.0, 3.0), (7e4, 500.0), (3.0, 2.0), (1.0, 2.0), (0.0, 1.0))):
        x[..., v] = mean + spread * (0.5 * rng.normal(size=(1, 1, 1, NE + 1)) + rng.normal(size=x.shape[:-1]))
    rows = [(i, j, k, m, *map(float, x[i, j, k, m])) for i in range(N) for j in range(N) for k in range(2) for m in range(NE + 1)]
    state = spark.createDataFrame(rows, "i int, j int, k int, m int, " + ", ".join(f"{v} double" for v in VARIABLES)).cache()
    grid = spark.createDataFrame([(i, j, k, 2.0 * i, 2.0 * j, 1.0 * k) for i in range(N) for j in range(N) for k in range(2)], "i int, j int, k int, x_km double, y_km double, z_km double").cache()
    return x, state, grid


def hx(x):
    g = {v: n for n, v in enumerate(VARIABLES)}
    return np.array([reflectivity(*(m[g[v]] for v in ("qr", "qs", "qg", "t", "p"))) for m in x])


def gain_update(x, obs, scale, cutoff):
    """Mean and covariance of each point's analysis from Kalman's formulas in observation space; x [..., members, variables]."""
    out = {}
    for at in np.ndindex(x.shape[:3]):
        own = [(y, yo, r0 / max(math.exp(-0.5 * d2), 1e-6)) for (p, y, yo, r0) in obs if (d2 := sum(((a - b) * s / scale) ** 2 for a, b, s in zip(at, p, (2.0, 2.0, 1.0), strict=True))) <= cutoff]
        m = x[at]
        mean, a = m.mean(0), m - m.mean(0)
        if not own:
            out[at] = mean, a.T @ a / (len(m) - 1)
            continue
        y = np.stack([o[0] for o in own])
        dy, ne = y - y.mean(1, keepdims=True), len(m)
        pxy, pyy = a.T @ dy.T / (ne - 1), dy @ dy.T / (ne - 1)
        k = pxy @ np.linalg.inv(pyy + np.diag([o[2] for o in own]))
        out[at] = mean + k @ (np.array([o[1] for o in own]) - y.mean(1)), a.T @ a / (ne - 1) - k @ pxy.T
    return out


def collect(df, names):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[n] for n in names), {})[r.m] = np.array([r[v] for v in VARIABLES])
    return {k: np.stack([v[m] for m in sorted(v)]) for k, v in out.items()}


def make_obs(spark, domain, points):
    x, *_ = domain
    rows = [(n, *p, 2.0 * p[0], 2.0 * p[1], 1.0 * p[2], float(hx(x[p][NE:])[0]), float(hx(x[p][NE:])[0]), 5.0) for n, p in enumerate(points)]
    return spark.createDataFrame(rows, "obs_id long, i int, j int, k int, x_km double, y_km double, z_km double, yo double, yo_clean double, r0 double")


def test_many_observations_against_gain(spark, domain):
    x, state, grid = domain
    points = [(0, 0, 0), (2, 2, 1), (3, 2, 0), (4, 4, 1)]
    obs = make_obs(spark, domain, points)
    prior = state.where(F.col("m") < NE)
    scale = 2.0
    done = collect(multi_obs.assimilate(prior, obs, grid, method="LETKF", scales=(scale,) * 3).state, ("i", "j", "k"))
    xp = x[..., :NE, :]
    cutoff = math.sqrt(physics.SUPPORT2) * scale
    want = gain_update(xp, [(p, hx(xp[p]), hx(x[p][NE:])[0], 5.0) for p in points], scale, cutoff)
    assert len(done) == N * N * 2
    for at, (mean, cov) in want.items():
        assert done[at].mean(0) == pytest.approx(mean, rel=1e-8, abs=1e-9)
        assert np.cov(done[at].T) == pytest.approx(cov, rel=1e-6, abs=1e-7)


def test_tiles_lose_nothing(spark, domain):
    _, state, grid = domain
    obs = make_obs(spark, domain, [(0, 0, 0), (2, 3, 1), (4, 4, 0)])
    prior = state.where(F.col("m") < NE)
    seen = multi_obs.observed(prior, obs).withColumn("r", F.col("r0"))
    runs = [collect(multi_obs.letkf(prior, seen, grid, scales=(1.0, 1.0, 1.0), tile_km=t), ("i", "j", "k")) for t in (1.5, 4.0, 100.0)]
    for other in runs[1:]:
        assert all(np.array_equal(runs[0][k], other[k]) for k in runs[0])


def test_parts_are_wide_where_the_reach_is_short(spark):
    """A part has points enough to be worth a kernel's call, and few observations go to several parts."""
    grid = spark.range(60 * 60).selectExpr("int(id % 60) as i", "int(id div 60) as j", "0 as k", "2.0d * (id % 60) as x_km", "2.0d * (id div 60) as y_km", "0.0d as z_km")
    obs = grid.where("i % 2 = 0 and j % 2 = 0").selectExpr("x_km", "y_km", "z_km", "30.0d as yo", "5.0d as r", "array(1.0d) as y", "array(0) as ym")
    own, spread = multi_obs.deal(obs, grid, [2.6, 2.6, 2.6], None, 900)
    parts = own.groupBy(*multi_obs.PART).count().toPandas()["count"]
    assert len(parts) <= 25 and parts.max() <= 900 and parts.sum() == 3600
    assert 900 < spread.count() < 1.5 * 900


def single(spark, domain, method, ntemp, point=(2, 2, 1), steps=None, scale=2.0):
    _, state, grid = domain
    obs = make_obs(spark, domain, [point])
    table = spark.createDataFrame([(0, method, ntemp, 1.0, scale, scale, scale)], COMBOS)
    rows = single_obs.with_members(neighbours.localised_pairs(obs, table, grid), state.where(F.col("m") < NE))
    return single_obs.analyse(rows, steps or ntemp)


def test_closed_form_equals_kernel(spark, domain):
    _, state, grid = domain
    obs = make_obs(spark, domain, [(2, 2, 1)])
    prior = state.where(F.col("m") < NE)
    for method, ntemp, steps in (("LETKF", 1, 1), ("TEnKF", 2, 2), ("AOEI", 1, 1), ("TAOEI", 2, 2), ("ATEnKF", 1, 6)):
        a = collect(single(spark, domain, method, ntemp, steps=steps), ("gi", "gj", "gk"))
        b = collect(multi_obs.assimilate(prior, obs, grid, method=method, ntemp=ntemp, alpha_s=1.0, scales=(2.0,) * 3).state, ("i", "j", "k"))
        assert a and all(a[k] == pytest.approx(b[k], rel=1e-7, abs=1e-9) for k in a), method


def test_laws_of_one_observation(spark, domain):
    x, *_ = domain
    out = collect(single(spark, domain, "LETKF", 1), ("gi", "gj", "gk"))
    for at, m in out.items():
        before = x[at][:NE].var(0, ddof=1)
        assert (m.var(0, ddof=1) <= before * (1 + 1e-9)).all()
    assert len(collect(single(spark, domain, "LETKF", 1, scale=1.0), ("gi", "gj", "gk"))) < N * N * 2
    one = collect(single(spark, domain, "TEnKF", 1), ("gi", "gj", "gk"))
    assert all(np.allclose(one[k], out[k], rtol=1e-12) for k in out)


def test_without_spread_nothing_changes(spark, domain):
    _, state, grid = domain
    flat = state.where("m < 3").drop("m").groupBy("i", "j", "k").agg(*(F.first(v).alias(v) for v in VARIABLES)).crossJoin(spark.range(3).select(F.col("id").cast("int").alias("m")))
    obs = make_obs(spark, domain, [(1, 1, 0)])
    table = spark.createDataFrame([(0, "LETKF", 1, 1.0, 2.0, 2.0, 2.0)], COMBOS)
    rows = single_obs.analyse(single_obs.with_members(neighbours.localised_pairs(obs, table, grid), flat), 1)
    assert rows.where(" or ".join(f"{v} <> f_{v}" for v in VARIABLES)).count() == 0


def test_no_observations(spark, domain):
    _, state, grid = domain
    obs = make_obs(spark, domain, [(1, 1, 0)]).limit(0)
    prior = state.where(F.col("m") < NE)
    done = collect(multi_obs.assimilate(prior, obs, grid, method="LETKF", scales=(2.0,) * 3).state, ("i", "j", "k"))
    before = collect(prior, ("i", "j", "k"))
    assert all(np.array_equal(done[k], before[k]) for k in before)
    table = spark.createDataFrame([(0, "LETKF", 1, 1.0, 2.0, 2.0, 2.0)], COMBOS)
    assert single_obs.sweep(obs, table, grid, prior, state.where(F.col("m") == NE).drop("m"), steps=1).count() == 0


def test_runner_modes_and_report(spark, domain):
    _, state, grid = domain
    config = {"mode": "sweep", "truth_member": NE, "prior_size": NE, "qc": {"dbz_min": 5.0}, "sweep": {"method": ["TEnKF", "AOEI"], "ntemp": [1, 2], "loc_x": 2.0, "loc_y": 2.0, "loc_z": 2.0, "stride": 2}}
    sweep = runner.run(spark, config, state, grid)
    assert sweep.select("obs_id").distinct().count() == 18
    assert sweep.count() == 18 * 3 * 9
    one = runner.run(spark, config | {"mode": {"type": "single_obs"}, "point": {"i": 2, "j": 2, "k": 1}}, state, grid)
    assert one.count() == 27
    a = {(r.combo_id, r["var"]): r.rmse_a for r in one.collect()}
    b = {(r.combo_id, r["var"]): r.rmse_a for r in sweep.where("i = 2 and j = 2 and k = 1").collect()}
    assert a == pytest.approx(b)
    many = runner.run(spark, config | {"mode": "strided", "sweep": config["sweep"] | {"method": "TEnKF", "ntemp": 1}}, state, grid)
    assert many.count() == 8
    with pytest.raises(ValueError):
        runner.run(spark, config | {"mode": "other"}, state, grid)
    report = runner.sanity_report(spark, make_obs(spark, domain, [(2, 2, 1)]), grid, state.where(F.col("m") < NE))
    assert {r.method for r in report.collect()} == {"LETKF", "TEnKF", "AOEI", "ATEnKF", "TAOEI"}


def test_atenkf_query_runs_every_step_observations_need(spark):
    rows, sf_dir = [("ATEnKF", 1, 1.0, 2.0, 2.0, 2.0)], "/root/testdata/sf0.01"
    obs, _, prior = catalog._obs(spark, sf_dir, 2)
    members = single_obs.with_members(neighbours.localised_pairs(obs, catalog._combos(spark, rows), fixtures.grid(spark)), prior)
    assert single_obs.own_steps(members) == 5
    key = ("obs_id", "gi", "gj", "gk")
    mean = lambda steps: {tuple(r[:4]): r.mean_t for r in single_obs.analyse(members, steps).groupBy(*key).agg(F.avg("t").alias("mean_t")).collect()}
    got = {tuple(r[k] for k in key): r.mean_t for r in catalog.QUERIES["atenkf_single"](spark, sf_dir).collect()}
    cut, whole = mean(4), mean(6)
    assert got == pytest.approx(whole, abs=1e-3) and got != pytest.approx(cut, abs=1e-3)


def test_sanity_report_runs_every_step(spark, domain):
    _, state, grid = domain
    prior = state.where(F.col("m") < NE)
    obs = make_obs(spark, domain, [(2, 2, 1)]).withColumn("yo", F.lit(100.0))
    first = runner.sanity_report(spark, obs, grid, prior, ntemp=1, alpha_s=0.0).where("method = 'LETKF'").first()
    obs = obs.withColumn("r0", F.lit((first.dep_b**2 - first.spread_b**2) / 7.5))  # equal weights: 8 steps
    got = runner.sanity_report(spark, obs, grid, prior, ntemp=1, alpha_s=0.0).where("method = 'ATEnKF'").first()
    table = spark.createDataFrame([(0, "ATEnKF", 1, 0.0, 5.0, 5.0, 5.0)], COMBOS)
    members = single_obs.with_members(neighbours.localised_pairs(obs, table, grid), prior)
    dep = lambda steps: single_obs.moments(single_obs.analyse(members, steps).where("at_obs")).select(F.col("yo") - F.col("ma_ref")).first()[0]
    assert single_obs.own_steps(members) == 8
    assert got.dep_a == pytest.approx(dep(9)) and got.dep_a != pytest.approx(dep(6))


def test_absent_members_do_not_enter(spark, domain):
    x, state, grid = domain
    prior = state.where(F.col("m") < NE)
    point = (2, 2, 1)
    obs = make_obs(spark, domain, [point])
    # One point lacks member 1, another member 4; the observed point lacks member 6.
    gaps = "not (i = 2 and j = 2 and k = 0 and m = 1) and not (i = 1 and j = 2 and k = 1 and m = 4) and not (i = 2 and j = 2 and k = 1 and m = 6)"
    done = collect(multi_obs.assimilate(prior.where(gaps), obs, grid, method="LETKF", scales=(2.0,) * 3).state, ("i", "j", "k"))
    shared = [0, 1, 2, 3, 4, 5]
    for at, absent in (((2, 2, 0), [1]), ((1, 2, 1), [4]), ((2, 2, 1), [6]), ((3, 2, 1), [])):
        present = [m for m in range(NE) if m not in absent]
        used = [m for m in present if m in shared]
        sub = x[:, :, :, used, :]
        want = gain_update(sub, [(point, hx(x[point][used]), hx(x[point][NE:])[0], 5.0)], 2.0, math.sqrt(physics.SUPPORT2) * 2.0)[at]
        rows = done[at]
        assert len(rows) == len(present)
        mine = rows[[n for n, m in enumerate(present) if m in shared]]
        assert mine.mean(0) == pytest.approx(want[0], rel=1e-8, abs=1e-9)
        assert np.cov(mine.T) == pytest.approx(want[1], rel=1e-6, abs=1e-7)
        for n, m in enumerate(present):
            if m not in shared:
                assert np.array_equal(rows[n], x[at][m])


def test_steps_are_reported(spark, domain):
    x, state, grid = domain
    obs = make_obs(spark, domain, [(2, 2, 1), (0, 0, 0)])
    prior = state.where(F.col("m") < NE)
    done = multi_obs.assimilate(prior, obs, grid, method="TEnKF", ntemp=2, alpha_s=1.0, scales=(2.0,) * 3)
    rows = {(r.step, r.obs_id): r for r in done.steps.collect()}
    assert set(rows) == {(s, o) for s in (1, 2) for o in (0, 1)}
    assert rows[1, 0].hxf == pytest.approx(hx(x[2, 2, 1][:NE]).tolist())
    assert rows[1, 0].dep == pytest.approx(hx(x[2, 2, 1][NE:])[0] - np.mean(rows[1, 0].hxf))
    assert sum(rows[s, 0].weight for s in (1, 2)) == pytest.approx(1)
    assert rows[2, 0].hxf != rows[1, 0].hxf
    counted = {(r.i, r.j, r.k): r.n_obs for r in done.n_obs.collect()}
    assert counted[2, 2, 1] >= 1 and set(counted.values()) <= {0, 1, 2}


def test_configurations_as_published(spark, domain, tmp_path):
    """Keys of the sweep, single and many-observation configurations."""
    _, state, grid = domain
    config = {
        "experiment_tag": "T", "verbose": 0, "skip_existing": True, "store_fields": False, "cutoff_factor": 4.0,
        "paths": {"prepared": "p", "outdir": "o"}, "state": {"n_members": 8, "var_idx": {}}, "obs": {"obs_error_var": 5.0},
        "qc": {"filter_ensemble": True, "filter_truth": False, "filter_mode": "and", "dbz_min": 5.0},
        "sweep": {"truth_members": [NE], "prior_size": NE, "obs_points": {"mode": "sweep"}, "stride": 2, "methods": ["TEnKF", "AOEI"], "ntemp": [1, 2], "alpha_s": 2.0, "loc_x": 2.0, "loc_y": 2.0, "loc_z": 2.0},
    }
    sweep = runner.run(spark, config, state, grid)
    assert {(r.method, r.ntemp) for r in sweep.select("method", "ntemp").distinct().collect()} == {("TEnKF", 1), ("TEnKF", 2), ("AOEI", 1)}
    assert sweep.count() == 18 * 3 * 9
    one = runner.run(spark, config | {"sweep": config["sweep"] | {"obs_points": {"mode": "single_obs", "loc": {"x": 2, "y": 2, "z": 1}}}}, state, grid)
    assert one.count() == 27
    many = config | {"sweep": config["sweep"] | {"obs_points": {"mode": "multi_obs"}, "ntemp": [1]}}
    out = str(tmp_path / "many")
    first = {tuple(r) for r in runner.run(spark, many, state, grid, outdir=out).collect()}
    assert len(first) == 16
    reference = spark.read.parquet(f"{out}/reference/tm={NE}")
    assert reference.count() == N * N * 2 and reference.where("yo is not null").count() == 18
    from cirrostrat.sources import results

    assert results.read_fields(spark, f"{out}/analysis/tm={NE}", 1).count() > 0
    assert spark.read.parquet(f"{out}/steps/tm={NE}").where("combo_id = 0").count() == 18
    stamps = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "many" / "analysis").rglob("*.parquet")}
    before = stamps()
    again = {tuple(r[c] for c in ("combo_id", "method", "ntemp")) for r in runner.run(spark, many, state, grid, outdir=out).collect()}
    assert again == {(r[0], r[1], r[2]) for r in first} and stamps() == before
    runner.run(spark, many | {"store_fields": True, "skip_existing": False}, state, grid, outdir=out)
    assert results.read_fields(spark, f"{out}/analysis/tm={NE}", 0).where("var = 't'").count() == N * N * 2 * NE
    with pytest.raises(ValueError):
        runner.run(spark, config | {"sweep": config["sweep"] | {"metods": ["AOEI"]}}, state, grid)


def test_box_about_observations(spark, domain):
    _, _, grid = domain
    obs = make_obs(spark, domain, [(2, 2, 1), (4, 0, 0)])
    table = spark.createDataFrame([(0, "LETKF", 1, 1.0, 2.0, 2.0, 2.0)], COMBOS)
    pairs = neighbours.localised_pairs(obs, table, grid)
    assert neighbours.in_box(pairs, grid, 4.0).count() == pairs.count()
    small = neighbours.in_box(pairs, grid, 1.0)
    assert {(r.obs_id, r.gi, r.gj, r.gk) for r in small.collect()} == {(r.obs_id, r.gi, r.gj, r.gk) for r in pairs.collect() if abs(r.gi - r.i) <= 1 and abs(r.gj - r.j) <= 1}


def test_prior_report_and_schedule(spark, domain):
    x, state, _ = domain
    obs = make_obs(spark, domain, [(2, 2, 1)])
    r = runner.prior_report(obs, state.where(F.col("m") < NE)).first()
    y = hx(x[2, 2, 1][:NE])
    assert (r["mean"], r.spread, r.members) == (pytest.approx(y.mean()), pytest.approx(y.std(ddof=1)), NE)
    rows = runner.schedule_preview(spark, 3, 2.0, 5.0).orderBy("step").collect()
    assert [q.weight for q in rows] == pytest.approx([0.00380626, 0.20781451, 0.78837925], abs=1e-6)
    assert sum(1 / q.error for q in rows) == pytest.approx(1 / 5)


def test_inflation_and_covariance(spark, domain):
    """The inflated gain formula; the covariance in the members' space gives the members' spread."""
    x, state, grid = domain
    points = [(0, 0, 0), (2, 2, 1), (3, 2, 0)]
    obs = make_obs(spark, domain, points)
    prior = state.where(F.col("m") < NE)
    seen = multi_obs.observed(prior, obs).withColumn("r", F.col("r0"))
    rho = 1.3
    xp = x[..., :NE, :]
    mean = xp.mean(3, keepdims=True)
    wide = mean + math.sqrt(rho) * (xp - mean)  # the prior with inflated deviations; observed values are inflated too
    given = [(p, hx(xp[p]).mean() + math.sqrt(rho) * (hx(xp[p]) - hx(xp[p]).mean()), hx(x[p][NE:])[0], 5.0) for p in points]
    want = gain_update(wide, given, 1.0, math.sqrt(physics.SUPPORT2))
    done = collect(multi_obs.letkf(prior, seen, grid, scales=(1.0,) * 3, inflation=rho).drop("n_obs"), ("i", "j", "k"))
    cov = {(r.i, r.j, r.k): r for r in multi_obs.covariance(prior, seen, grid, scales=(1.0,) * 3, inflation=rho).collect()}
    assert set(cov) == set(want) == set(done)
    for at, (m, c) in want.items():
        assert done[at].mean(0) == pytest.approx(m, rel=1e-8, abs=1e-9)
        assert np.cov(done[at].T) == pytest.approx(c, rel=1e-6, abs=1e-7)
        spread = np.array([cov[at][f"s_{v}"] for v in VARIABLES])
        assert spread == pytest.approx(done[at].std(0, ddof=1), rel=1e-7, abs=1e-9)
        pao = np.reshape(cov[at].covariance, (NE, NE))
        change = (xp - mean)[at]
        assert change.T @ pao @ change == pytest.approx(c, rel=1e-6, abs=1e-7)
    least = collect(multi_obs.letkf(prior, seen, grid, scales=(1.0,) * 3, least_inflation=rho).drop("n_obs"), ("i", "j", "k"))
    near = {(r.i, r.j, r.k): r.n_obs for r in multi_obs.letkf(prior, seen, grid, scales=(1.0,) * 3).collect()}
    assert all(np.array_equal(least[at], xp[at]) if near[at] == 0 else np.allclose(least[at], done[at], rtol=1e-12) for at in least)


def test_a_gap_far_away_changes_nothing_here(spark, domain):
    x, state, grid = domain
    points = [(0, 0, 0), (4, 4, 1)]
    obs = make_obs(spark, domain, points)
    prior = state.where(F.col("m") < NE)
    run = lambda p: collect(multi_obs.assimilate(p, obs, grid, method="LETKF", scales=(1.0,) * 3).state, ("i", "j", "k"))
    whole, gap = run(prior), run(prior.where("not (i = 4 and j = 4 and k = 1 and m = 6)"))
    moved = [at for at in whole if at != (4, 4, 1) and not np.array_equal(whole[at], gap[at])]
    assert moved and all(abs(i - 4) + abs(j - 4) <= 2 for i, j, _ in moved)
    assert not np.array_equal(whole[0, 0, 0], x[0, 0, 0][:NE]) and np.array_equal(whole[0, 0, 0], gap[0, 0, 0])
    # Where the gap is in reach, the member that lacks there stays as it is.
    assert all(np.array_equal(gap[at][6], x[at][6]) for at in moved)


@pytest.mark.parametrize("scales", [(1.0, 1.0, 1.0), (2.0, 2.0, 0.0)])
def test_crowded_tiles_are_cut(spark, domain, scales):
    """Parts of a few points give what a part of all gives."""
    _, state, grid = domain
    obs = make_obs(spark, domain, [(0, 0, 0), (2, 3, 1), (4, 4, 0), (1, 4, 1)])
    prior = state.where(F.col("m") < NE)
    seen = multi_obs.observed(prior, obs).withColumn("r", F.col("r0"))
    one = collect(multi_obs.letkf(prior, seen, grid, scales=scales, tile_km=100.0), ("i", "j", "k"))
    for most in (1, 3, 10):
        _, parts = multi_obs.parts_of(grid, 100.0, most)
        assert parts.count() > 50 / max(most, 2) / 4
        other = collect(multi_obs.letkf(prior, seen, grid, scales=scales, tile_km=100.0, most_points=most), ("i", "j", "k"))
        assert all(np.allclose(one[k], other[k], rtol=1e-12) for k in one) and set(one) == set(other)


def test_parts_hold_what_they_may(spark, domain):
    rng = np.random.default_rng(8)
    at = np.concatenate((rng.normal(0, 3, (3000, 2)), rng.uniform(-500, 500, (500, 2)), np.zeros((40, 2))))
    grid = spark.createDataFrame([(n, 0, 0, float(a), float(b), 0.0) for n, (a, b) in enumerate(at)], "i int, j int, k int, x_km double, y_km double, z_km double")
    placed, parts = multi_obs.parts_of(grid, 64.0, 100)
    sizes = placed.groupBy("part_x", "part_y", "level").count().collect()
    assert sum(r["count"] for r in sizes) == len(at) and len(sizes) == parts.count()
    assert all(r["count"] <= 100 or r.level == multi_obs.DEPTH for r in sizes) and len({r.level for r in sizes}) > 2
    inside = placed.where("x_km >= part_x * 64 / pow(2, level) and x_km < (part_x + 1) * 64 / pow(2, level) and y_km >= part_y * 64 / pow(2, level) and y_km < (part_y + 1) * 64 / pow(2, level)")
    assert inside.count() == len(at)


def test_without_a_horizontal_scale_no_task_holds_the_domain(spark, domain):
    x, state, grid = domain
    points = [(0, 0, 0), (2, 2, 1), (4, 3, 0)]
    obs = make_obs(spark, domain, points)
    prior = state.where(F.col("m") < NE)
    seen = multi_obs.observed(prior, obs).withColumn("r", F.col("r0"))
    scales = (0.0, 0.0, 2.0)
    one = collect(multi_obs.letkf(prior, seen, grid, scales=scales), ("i", "j", "k"))
    many = multi_obs.letkf(prior, seen, grid, scales=scales, most_points=5)
    assert all(np.allclose(v, one[k], rtol=1e-12) for k, v in collect(many, ("i", "j", "k")).items())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        dealt = many.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.countDistinct("i", "j", "k").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) > 1 and max(r.n for r in dealt) < N * N * 2


@pytest.mark.parametrize("gaps", [False, True])
def test_steps_in_one_plan(spark, domain, gaps):
    """The kernel that goes through all steps equals nested steps; with missing members too, where errors don't depend
    on the ensemble (the kernel takes those from the observation's own members, nested steps from each point's)."""
    from cirrostrat.operators import steps

    _, state, grid = domain
    prior = state.where(F.col("m") < NE)
    if gaps:
        prior = prior.where("not (i = 2 and j = 2 and k = 0 and m = 1) and not (i = 2 and j = 2 and k = 1 and m = 6)")
    obs = make_obs(spark, domain, [(2, 2, 1), (0, 1, 0)]).withColumn("yo", F.col("yo") + 5.0)
    methods = [("TEnKF", 3, 2.0), ("LETKF", 1, 1.0)] if gaps else [("ATEnKF", 1, 1.0), ("ATEnKF", 1, 0.0), ("TEnKF", 3, 2.0), ("AOEI", 1, 1.0), ("TAOEI", 2, 1.0)]
    table = spark.createDataFrame([(n, *c, 2.0, 2.0, 2.0) for n, c in enumerate(methods)], COMBOS)
    pairs = neighbours.localised_pairs(obs, table, grid)
    members = single_obs.with_members(pairs, prior)
    most = 3 if gaps else single_obs.own_steps(members)
    assert 2 < most <= 20
    want, got = single_obs.analyse(members, most), steps.analyse(pairs, prior)
    columns = [*VARIABLES, *(f"f_{v}" for v in VARIABLES), "at_obs", "err_1", *([] if gaps else ["own_ntemp"])]
    shown = lambda df: {tuple(r[k] for k in ("obs_id", "combo_id", "gi", "gj", "gk", "m")): [r[v] for v in columns] for r in df.collect()}
    a, b = shown(got), shown(want)
    assert set(a) == set(b) and len(a) > 300
    for k in a:
        for x, y in zip(a[k], b[k], strict=True):
            assert (x is None and y is None) or x == pytest.approx(y, rel=1e-7, abs=1e-9), k
    depth = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert depth(got) == depth(steps.analyse(pairs.where("method = 'LETKF'"), prior))
    assert single_obs.moments(got).count() == pairs.count()
    assert steps.analyse(pairs.limit(0), prior).count() == 0


def test_sweep_stores_its_zones(spark, domain, tmp_path):
    """The analysed zones of all combinations, of methods of few and of many steps; a run again replaces them."""
    _, state, grid = domain
    config = {"mode": "sweep", "truth_member": NE, "prior_size": NE, "store_fields": True, "sweep": {"methods": ["LETKF", "ATEnKF"], "loc_x": 1.0, "loc_y": 1.0, "loc_z": 1.0, "stride": 2}}
    out = str(tmp_path / "out")
    for _ in range(2):
        runner.run(spark, config, state, grid, outdir=out)
    stored = spark.read.parquet(f"{out}/fields/tm={NE}")
    assert {r.combo_id for r in stored.select("combo_id").distinct().collect()} == {0, 1}
    truth, prior = state.where(F.col("m") == NE).drop("m"), state.where(F.col("m") < NE)
    obs = runner.observations_of(spark, config, NE, grid, truth, prior)
    pairs = neighbours.localised_pairs(obs, catalog.combo_ops.combo_table(spark, config["sweep"]), grid)
    rows = single_obs.analyse(single_obs.with_members(pairs, prior).where("method = 'LETKF'"), 1)
    want = {(r.obs_id, r.gi, r.gj, r.gk, r.m): r.t for r in rows.collect()}
    got = {(r.obs_id, r.i, r.j, r.k, r.m): r.t for r in stored.where("combo_id = 0").collect()}
    assert got == pytest.approx(want, rel=1e-9)
    assert stored.where("combo_id = 1").count() == len(want)
