import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat.functions import physics, stats
from cirrostrat.operators import combos, ensemble, neighbours, verification


def reflectivity(qr, qs, qg, t, p):
    """By hand, one point at a time."""
    pip = 3.14159265358979**1.75
    ro = p / (287.0 * t)
    z = 0.0
    if qr > 0:
        z += 1e18 * 720 / (pip * 8e6**0.75 * 1000**1.75) * (ro * qr) ** 1.75
    if qs > 0:
        dry = 1e18 * 720 * 0.176 * 100**0.25 / (pip * 0.93 * 2e6**0.75 * 917**2)
        wet = 1e18 * 720 / (pip * 2e6**0.75 * 100**1.75)
        z += (dry if t <= 273.16 else wet) * (ro * qs) ** 1.75
    if qg > 0:
        z += (1e18 * 720 / (pip * 4e6**0.75 * 913**1.75)) ** 0.95 * (ro * qg) ** 1.6625
    return max(10 * math.log10(z), -20.0) if z > 0 else -20.0


def test_reflectivity(spark):
    cases = [(1e-3, 0.0, 0.0, 280.0, 9e4), (0.0, 1e-3, 0.0, 273.16, 7e4), (0.0, 1e-3, 0.0, 273.17, 7e4), (1e-3, 2e-3, 3e-3, 260.0, 5e4), (0.0, 0.0, 0.0, 280.0, 9e4), (-1e-3, 0.0, 1e-9, 280.0, 9e4)]
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "n int, qr double, qs double, qg double, t double, p double")
    got = [r.y for r in df.select("n", physics.h().alias("y")).orderBy("n").collect()]
    assert got == pytest.approx([reflectivity(*c) for c in cases], rel=1e-12)


def test_reflectivity_of_missing_values(spark):
    nan = float("nan")
    rows = [(nan, 0.0, 0.0, 280.0, 9e4), (None, None, None, 280.0, 9e4), (1e-3, 0.0, 0.0, nan, 9e4), (1e-3, 0.0, 0.0, 280.0, None), (nan, 0.0, 1e-3, 280.0, 9e4)]
    df = spark.createDataFrame(rows, "qr double, qs double, qg double, t double, p double")
    got = [r[0] for r in df.select(physics.h()).collect()]
    assert got[:4] == [-20.0] * 4
    assert got[4] == pytest.approx(reflectivity(0, 0, 1e-3, 280.0, 9e4))


def test_quality_truth_table(spark):
    for fe, ft, mode, (bad_e, bad_t) in itertools.product((True, False), (True, False), ("and", "or"), itertools.product((True, False), repeat=2)):
        ok_e, ok_t = not (fe and bad_e), not (ft and bad_t)
        want = (ok_e or ok_t if mode == "or" else ok_e and ok_t) if fe and ft else (ok_e and ok_t)
        c = physics.quality_pass(F.lit(1.0 if bad_t else 9.0), F.lit(1.0 if bad_e else 9.0), filter_ensemble=fe, filter_truth=ft, mode=mode)
        assert spark.range(1).select(c).first()[0] is want


def test_cutoff_is_inclusive(spark):
    d = math.sqrt(physics.SUPPORT2)
    df = spark.createDataFrame([(d * d,), (d * d + 1e-9,)], "d2 double").select(physics.weight(F.col("d2")))
    assert [r[0] > 0 for r in df.collect()] == [True, False]


def test_disabled_axis(spark):
    c = physics.distance2(F.lit(5.0), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(None).cast("double"))
    assert spark.range(1).select(c).first()[0] == pytest.approx(0.25)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(-20.0,), (20.0,), (20.01,), (0.0,), (float("nan"),), (None,)], "x double")
    got = [r[0] for r in df.select(stats.bin_of(F.col("x"), -20.0, 20.0, 50)).collect()]
    assert got == [0, 49, None, 25, None, None]


def test_combinations():
    got = combos.combinations({"method": ["TEnKF", "AOEI"], "ntemp": {"start": 1, "stop": 3, "num": 5}, "alpha_s": [1.0, 2.0], "loc_x": None, "loc_y": 2, "loc_z": [1, 1]})
    assert got == [("TEnKF", n, a, 0.0, 2.0, 1.0) for n in (1, 2, 3) for a in (1.0, 2.0)] + [("AOEI", 1, a, 0.0, 2.0, 1.0) for a in (1.0, 2.0)]
    with pytest.raises(ValueError):
        combos.combinations({"method": "other"})


def test_range_join_is_no_product(spark):
    grid = spark.range(400).select((F.col("id") % 20).cast("int").alias("i"), F.floor(F.col("id") / 20).cast("int").alias("j"), F.lit(0).alias("k"))
    grid = grid.select("*", (F.col("i") * 2.0).alias("x_km"), (F.col("j") * 2.0).alias("y_km"), F.lit(0.0).alias("z_km"))
    obs = grid.where("i % 7 = 0 and j % 5 = 0").select(F.col("i").cast("long").alias("obs_id"), "i", "j", "k", "x_km", "y_km", "z_km")
    for tile in (1.0, 3.0, 50.0):
        got = neighbours.range_join(obs, grid, F.lit(5.0), tile)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        want = sum(abs(a - i) * 2 <= 5 and abs(b - j) * 2 <= 5 for i in range(0, 20, 7) for j in range(0, 20, 5) for a in range(20) for b in range(20))
        assert got.count() == want == got.distinct().count()


def test_box_counts_from_the_end(spark):
    df = spark.range(10).select(F.col("id").cast("int").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("k"))
    assert sorted(r.i for r in ensemble.box(df, i=(2, -1)).collect()) == list(range(2, 9))
    assert sorted(r.i for r in ensemble.box(df, i=(-3, None)).collect()) == [7, 8, 9]


def test_prior_size(spark):
    state = spark.createDataFrame([(0, 0, 0, m) for m in range(5)], "i int, j int, k int, m int")
    assert sorted(r.m for r in ensemble.prior_of(state, 2, 3).collect()) == [0, 1, 3]
    with pytest.raises(ValueError):
        ensemble.prior_of(state, 2, 5)


def test_tight_box_of_nothing(spark):
    field = spark.createDataFrame([(i, j, 0.0) for i in range(3) for j in range(4)], "a int, b int, v double")
    assert list(verification.tight_box(field, "a", "b", "v", threshold=1.0).first()) == [-0.5, 2.5, -0.5, 3.5]


def test_noise_is_reproducible(spark):
    a = ensemble.noise_field(spark, (2, 3, 2), 4, 5.0).orderBy("i", "j", "k").collect()
    want = np.random.default_rng(46).normal(0.0, np.sqrt(5.0), (2, 3, 2)).astype(np.float32).ravel()
    assert [r.noise for r in a] == pytest.approx(want.tolist())


def test_nearest_of_many_targets(spark):
    """By cells as by all points: ties, targets far outside, points in a line and in one place; no product in the plan."""
    from cirrostrat.operators import neighbours

    rng = np.random.default_rng(9)
    grids = {
        "lattice": [(j, i, -35 + 0.1 * j, -60 + 0.1 * i) for j in range(30) for i in range(40)],
        "clusters": [(n, 0, float(a), float(b)) for n, (a, b) in enumerate(np.concatenate((rng.normal(0, 0.01, (300, 2)), rng.uniform(-5, 5, (50, 2)))))],
        "line": [(n, 0, 1.0, 0.5 * n) for n in range(50)],
        "place": [(1, 2, 3.0, 4.0), (1, 1, 3.0, 4.0)],
    }
    targets = [(f"t{n}", float(a), float(b)) for n, (a, b) in enumerate(rng.uniform(-70, 10, (60, 2)))]
    targets += [(f"m{n}", -35 + 0.05 * n, -59.95) for n in range(20)] + [("far", 5000.0, -9000.0), ("in", 0.0, 0.0)]
    t = spark.createDataFrame(targets, "name string, lat double, lon double")
    for name, rows in grids.items():
        p = spark.createDataFrame(rows, "j int, i int, lat double, lon double")
        key = lambda df: {r["name"]: (r.j, r.i) for r in df.collect()}
        got = neighbours.nearest(p, t)
        assert key(got) == key(neighbours.nearest(p, t, few=1000)), name
    assert "Nested" not in got._jdf.queryExecution().toString()
    none = spark.createDataFrame([], "j int, i int, lat double, lon double")
    assert neighbours.nearest(none, t).count() == 0
