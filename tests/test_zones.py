"""Metrics of many analyses with one observation by parts of the domain, against windows over every zone."""

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from cirrostrat.operators import multi_obs, neighbours, single_obs, zones
from cirrostrat.schema import COMBOS, VARIABLES
from tests.test_analysis import NE, N, domain, make_obs  # noqa: F401  a fixture

METHODS = [("LETKF", 1, 1.0), ("TEnKF", 1, 1.0), ("TEnKF", 3, 2.0), ("AOEI", 1, 1.0), ("TAOEI", 2, 0.5), ("ATEnKF", 1, 1.0)]


def by_windows(obs, table, grid, prior, truth, steps, cutoff="reference"):
    pairs = neighbours.localised_pairs(obs, table, grid, cutoff=cutoff)
    return single_obs.metrics(single_obs.with_truth(single_obs.moments(single_obs.analyse(single_obs.with_members(pairs, prior), steps)), truth))


def shown(df):
    return {(r.obs_id, r.combo_id, r["var"]): r.asDict() for r in df.collect()}


def same(got, want):
    assert set(got) == set(want) and want
    for k in want:
        assert list(got[k]) == list(want[k])
        for c, v in want[k].items():
            assert got[k][c] == (pytest.approx(v, rel=1e-6, abs=1e-8, nan_ok=True) if isinstance(v, float) else v), (k, c, got[k][c], v)


def combos(spark, scales, methods=METHODS):
    return spark.createDataFrame([(n, *m, *scales) for n, m in enumerate(methods)], COMBOS)


def split(state):
    return state.where(F.col("m") < NE), state.where(F.col("m") == NE).drop("m")


def shuffled(spark, act):
    """Rows that act shuffles."""
    sc, jvm = spark.sparkContext, spark._jvm

    def written():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s := stages.apply(n)).stageId(): s.shuffleWriteRecords() for n in range(stages.size())}

    before = written()
    act()
    return sum(v for k, v in written().items() if k not in before)


@pytest.mark.parametrize("scales", [(1.0, 1.0, 1.0), (1.5, 0.7, 0.0)])
@pytest.mark.parametrize("cutoff", ["reference", "consistent"])
def test_parts_equal_windows(spark, domain, monkeypatch, scales, cutoff):  # noqa: F811
    """All methods, a vertical axis without scale, parts of a few points, blocks of a few observations and pairs."""
    _, state, grid = domain
    prior, truth = split(state)
    obs = make_obs(spark, domain, [(i, j, k) for i in range(N) for j in range(N) for k in range(2) if (i + j) % 2]).withColumn("yo", F.col("yo") + F.col("obs_id") % 7 - 3)
    table = combos(spark, scales)
    want = shown(by_windows(obs, table, grid, prior, truth, 3, cutoff))
    same(shown(single_obs.sweep(obs, table, grid, prior, truth, steps=3, cutoff=cutoff)), want)
    monkeypatch.setattr(zones, "OBSERVATIONS", 3)
    monkeypatch.setattr(zones, "BLOCK", 5 * NE * len(VARIABLES))
    few = zones.sweep(obs, table, grid, prior, truth, most_steps=3, cutoff=cutoff, most_points=6)
    same(shown(single_obs._by_quantity(few.join(table, "combo_id"))), want)


def test_odd_rows(spark, domain):  # noqa: F811
    """Missing members, here and at an observation, null and nan values, a point without truth, one without members,
    one that is alone with one member, and an observation where no point is."""
    _, state, grid = domain
    at = lambda i, j, k: (F.col("i") == i) & (F.col("j") == j) & (F.col("k") == k)
    prior, truth = split(state)
    prior = prior.where(~(at(2, 2, 0) & (F.col("m") == 1)) & ~(at(2, 1, 1) & F.col("m").isin(5, 6)) & ~at(1, 1, 0) & ~(at(3, 3, 1) & (F.col("m") > 0)))
    prior = prior.withColumn("u", F.when(at(2, 3, 0) & (F.col("m") < 3), None).otherwise(F.col("u"))).withColumn("qr", F.when(at(1, 2, 1) & (F.col("m") == 2), None).otherwise(F.col("qr")))
    prior = prior.withColumn("v", F.when(at(2, 2, 1) & (F.col("m") > 0), None).otherwise(F.col("v"))).withColumn("w", F.when(at(3, 2, 0) & (F.col("m") == 4), float("nan")).otherwise(F.col("w")))
    truth = truth.where(~at(0, 2, 0)).withColumn("t", F.when(at(1, 2, 0), None).otherwise(F.col("t")))
    obs = make_obs(spark, domain, [(2, 2, 0), (2, 1, 1), (1, 1, 0), (3, 3, 1), (1, 2, 1), (4, 4, 1), (0, 2, 0)]).withColumn("yo", F.col("yo") + 4.0)
    stray = obs.where("obs_id = 5").select(F.lit(99).cast("long").alias("obs_id"), F.lit(70).alias("i"), F.lit(70).alias("j"), F.lit(0).alias("k"), F.lit(-1.5).alias("x_km"), F.lit(9.7).alias("y_km"), F.lit(0.0).alias("z_km"), "yo", "yo_clean", "r0")
    obs = obs.unionByName(stray)
    table = combos(spark, (1.0, 1.0, 1.0))
    want = shown(by_windows(obs, table, grid, prior, truth, 3))
    same(shown(single_obs.sweep(obs, table, grid, prior, truth, steps=3)), want)
    assert any(k[0] == 99 for k in want)
    few = zones.sweep(obs, table, grid, prior, truth, most_steps=3, most_points=4)
    same(shown(single_obs._by_quantity(few.join(table, "combo_id"))), want)


def test_without_a_horizontal_scale(spark, domain):  # noqa: F811
    _, state, grid = domain
    prior, truth = split(state)
    obs = make_obs(spark, domain, [(0, 0, 0), (4, 4, 1)])
    table = combos(spark, (0.0, 1.0, 1.0), METHODS[:2])
    assert not zones.fits(table)
    same(shown(single_obs.sweep(obs, table, grid, prior, truth, steps=1)), shown(by_windows(obs, table, grid, prior, truth, 1)))


def test_shuffles_no_zone(spark, domain):  # noqa: F811
    """Rows that a sweep shuffles are as many as points and members are; windows shuffle every zone with its members."""
    _, state, grid = domain
    prior, truth = split(state)
    obs = make_obs(spark, domain, [(i, j, k) for i in range(N) for j in range(N) for k in range(2)])
    table = combos(spark, (2.0, 2.0, 2.0), METHODS[:4])
    zone = neighbours.localised_pairs(obs, table, grid).count() * NE
    assert shuffled(spark, by_windows(obs, table, grid, prior, truth, 3).collect) >= zone
    assert shuffled(spark, single_obs.sweep(obs, table, grid, prior, truth, steps=3).collect) < zone / 10


def part_of_domain(n, members):
    """Points of a grid of 2 km and 1 km, as the kernel gets them, and observations at every other one."""
    rng = np.random.default_rng(3)
    i, j, k = (a.ravel().astype(np.int32) for a in np.meshgrid(np.arange(n), np.arange(n), np.arange(3), indexing="ij"))
    values = lambda v: rng.random((len(i), members)) * (0.002 if v.startswith("q") else 1.0) + {"t": 273.0, "p": 60000.0}.get(v, 0.0)
    at = {"gi": i, "gj": j, "gk": k, "gx": i * 2.0, "gy": j * 2.0, "gz": k * 1.0}
    arrays = {"ms": pa.array([list(range(members))] * len(i), pa.list_(pa.int32())), **{v: pa.array(list(values(v))) for v in VARIABLES}}
    points = pa.table({**at, **arrays, **{f"t_{v}": values(v)[:, 0] for v in (*VARIABLES, "ref")}, "counts": np.ones(len(i), bool)})
    o = np.flatnonzero((i % 2 == 0) & (j % 2 == 0))
    obs = pa.table({"obs_id": o, "yo": rng.random(len(o)) * 40, "yo_clean": rng.random(len(o)), "i": i[o], "j": j[o], "k": k[o], "x_km": i[o] * 2.0, "y_km": j[o] * 2.0, "z_km": k[o] * 1.0, "r0": np.full(len(o), 5.0)})
    return points, obs


def test_steps_only_what_they_update(monkeypatch):
    """Pairs beyond the cutoff stay as they are and go through no step; combinations that do the same are done once."""
    members, stepped = 6, []
    points, obs = part_of_domain(8, members)
    real = zones._step
    monkeypatch.setattr(zones, "_step", lambda x, *a: stepped.append(x.shape[2]) or real(x, *a))
    scales = (1.0, 1.0, 1.0)
    table = [(0, "LETKF", 1, 1.0, *scales), (1, "TEnKF", 1, 1.0, *scales), (2, "TEnKF", 2, 1.0, *scales), (3, "AOEI", 1, 1.0, *scales)]
    out = zones._kernel(table, 2, "reference")(points, obs)
    # A column has 3 points 1 km apart, of which an observation updates the 2 or 3 that are no further than 1 km; LETKF is TEnKF's one step.
    columns = obs.num_rows // 3
    assert sum(stepped) == (columns * 7 + columns * 3) * (1 + 2 + 1)
    of = lambda n: out.filter(pa.compute.equal(out.column("combo_id"), n)).drop_columns(["combo_id"])
    assert of(0).equals(of(1)) and not of(0).equals(of(2)) and out.num_rows == 4 * obs.num_rows


def test_parts_alone(spark):
    rows = [(float(n % 50), float(n // 50)) for n in range(2000)] + [(200.0 + n / 100, 7.0) for n in range(300)]
    grid = spark.createDataFrame(rows, "x_km double, y_km double")
    for most in (20, 300, 5000):
        want = multi_obs.parts_of(grid, 32.0, most)[1].select("tx", "ty", "level", "part_x", "part_y")
        got = multi_obs.parts_alone(grid, 32.0, most)
        assert sorted(got.collect()) == sorted(want.collect()) and got.dtypes == want.dtypes
