import datetime

import numpy as np
import pytest

from cirrostrat.schema import VARIABLES
from cirrostrat.sources import extract, results
from cirrostrat.streaming import innovation_windows


def test_names_and_paths():
    assert extract.member_names(1, 3, 2) == ["01", "02", "03"]
    got = extract.member_paths("/d/{init}/m{member}_{date}.nc", ["01"], datetime.datetime(2024, 1, 2, 3), init="x", date_format="%Y%m%d%H")
    assert got == [("01", "/d/x/m01_2024010203.nc")]


def test_members_and_lattice(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = {v: rng.normal(size=(2, 3, 2)) for v in VARIABLES}
    np.savez(tmp_path / "a.npz", **data)
    state = extract.read_members(spark, [("0", f"{tmp_path}/a.npz"), ("1", f"{tmp_path}/none.npz")])
    assert state.count() == 12
    assert state.where("i = 1 and j = 2 and k = 0").first().qr == data["qr"][1, 2, 0]
    full = extract.lattice(state, 2)
    assert full.count() == 24
    assert full.where("m = 1 and qr is null").count() == 12


def test_prepared_file(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(2, 2, 3, 4, 8)).astype(np.float32)
    x[:, :, 1] = np.nan
    at = np.random.default_rng(3).normal(size=(2, 2, 3, 3)).astype(np.float32)
    np.savez(tmp_path / "p.npz", state_ensemble=x, pos_km=at)
    state, grid = extract.import_prepared(spark, str(tmp_path / "p.npz"))
    assert state.count() == 2 * 2 * 2 * 4
    assert grid.where("i = 1 and j = 0 and k = 2").first().y_km == pytest.approx(float(at[1, 0, 2, 1]))
    np.savez(tmp_path / "q.npz", state_ensemble=x)
    with pytest.raises(KeyError):
        extract.import_prepared(spark, str(tmp_path / "q.npz"))


@pytest.mark.parametrize(("order", "save"), [("C", np.savez), ("F", np.savez), ("C", np.savez_compressed)])
def test_prepared_file_by_slabs(spark, tmp_path, monkeypatch, order, save):
    """Several tasks read an uncompressed archive, each its slab; a compressed one has the same rows."""
    monkeypatch.setattr(extract, "SLAB_BYTES", 1000)
    x = np.random.default_rng(5).normal(size=(6, 3, 2, 4, 8)).astype(np.float32)
    save(tmp_path / "p.npz", pos_km=np.random.default_rng(3).normal(size=(6, 3, 2, 3)), state_ensemble=np.asarray(x, order=order))
    state, grid = extract.import_prepared(spark, str(tmp_path / "p.npz"))
    got = {(r.i, r.j, r.k, r.m): tuple(r[v] for v in VARIABLES) for r in state.collect()}
    assert got == {at: tuple(x[at].astype(float)) for at in np.ndindex(x.shape[:4])} and grid.count() == 36
    slabs = extract._slabs(spark, str(tmp_path / "p.npz"), "state_ensemble", ("i", "j", "k", "m"), VARIABLES)
    assert slabs.rdd.getNumPartitions() == (1 if save is np.savez_compressed else min(6, -(-x.nbytes // 1000)))


def test_valid_times(spark):
    assert extract.valid_times(spark, "2024-01-01 00:00:00", "2024-01-01 03:00:00", "1 hour").count() == 4


def test_results_and_resumption(spark, tmp_path):
    combos = spark.createDataFrame([(0, "a"), (1, "b")], "combo_id int, method string")
    path = str(tmp_path / "out")
    assert results.unfinished(spark, combos, path).count() == 2
    results.write_analysis(spark.createDataFrame([(1.0,)], "x double"), path, 0)
    assert [r.combo_id for r in results.unfinished(spark, combos, path).collect()] == [1]
    results.write_sweep(combos, str(tmp_path / "sweep"), mode_name="sweep", members=4, truth=1)
    results.write_sweep(combos, str(tmp_path / "sweep"), mode_name="sweep", members=4, truth=1)
    assert results.collect_chunks(spark, str(tmp_path / "sweep")).count() == 2
    results.write_reference(combos, str(tmp_path / "ref"))
    results.write_reference(combos.limit(0), str(tmp_path / "ref"))
    assert spark.read.parquet(str(tmp_path / "ref")).count() == 2
    results.copy_config(spark, {"a": 1}, str(tmp_path / "config"))


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int),0) as ts, cast(id % 37 - 18 as double) as d from range(600)")
    rows.write.parquet(str(tmp_path / "in"))
    query = innovation_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((r.window.start, r.n, round(r["mean"], 9), round(r["std"], 9), r.large_share) for r in df.collect())
    assert key(spark.table("windows")) == key(innovation_windows(rows))


def post_file(path, rng, nz=3, ny=4, nx=5):
    data = {n: rng.normal(size=(1, nz, ny, nx)) for n in extract.POST_NAMES.values()}
    j, i = np.indices((ny, nx))
    np.savez(path, **data, XLAT=-35 + 0.02 * j, XLONG=-60 + 0.02 * i, level_z=np.array([250.0, 500.0, 1000.0][:nz]))
    return data


def test_job_over_times_members_and_missing_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    (tmp_path / "run").mkdir()
    made = {(t, m): post_file(tmp_path / "run" / f"{t}.{m}.npz", rng) for t in ("202401020000", "202401020100") for m in ("01", "02") if (t, m) != ("202401020100", "02")}
    config = {"cross_sections_job": {"format": "post", "paths": {"pattern": f"{tmp_path}/{{init}}/{{date}}.{{member}}.npz", "output": f"{tmp_path}/out_{{date}}.npz", "date_fmt": "%Y%m%d%H%M", "start": "run", "init_date": "2024-01-02_00:00:00", "end_date": "2024-01-02_01:00:00", "freq": "1H"}, "ensemble": {"mem_ini": 1, "mem_end": 2, "pad": 2}, "subset_3d": {"k_start": 1, "k_end": None, "j_start": 0, "j_end": -1, "i_start": 1, "i_end": 4}}}
    for _ in range(2):  # run again, it's the same
        out = extract.job(spark, config)
    state = spark.read.parquet(f"{out}/state")
    assert state.count() == 3 * 2 * 3 * 3
    got = state.where("hour(valid_time) = 1 and m = 0 and i = 2 and j = 1 and k = 0").first()
    raw = made["202401020100", "01"]
    assert got.qr == pytest.approx(raw["QRAIN"][0, 1, 1, 3] / 1000) and got.p == pytest.approx(raw["PRESSURE"][0, 1, 1, 3] * 100) and got.u == pytest.approx(raw["Umet"][0, 1, 1, 3])
    missing = spark.read.parquet(f"{out}/missing").collect()
    assert [(r.member, r.valid_time.hour) for r in missing] == [("02", 1)]
    grid = spark.read.parquet(f"{out}/grid")
    assert grid.count() == 2 * 3 * 3
    assert grid.where("i = 0 and j = 0").orderBy("k").first().z_km == 0.5
    assert grid.where("i = 0 and j = 2").first().y_km == pytest.approx(0.04 * 111.19, rel=0.01)
    assert extract.nearest_in_file(spark, str(tmp_path / "run" / "202401020000.01.npz"), -34.959, -59.941) == (2, 3)
    with pytest.raises(ValueError):
        extract.job(spark, {"cross_sections_job": config["cross_sections_job"] | {"format": "other"}})


def test_native_files(tmp_path):
    rng = np.random.default_rng(6)
    nz, ny, nx = 2, 3, 4
    shape = lambda **k: (2, nz + k.get("z", 0), ny + k.get("y", 0), nx + k.get("x", 0))
    data = {n: rng.normal(size=shape()) for n in ("QGRAUP", "QRAIN", "QSNOW", "T")}
    data |= {"P": rng.normal(size=shape()), "PB": np.full(shape(), 9e4), "U": rng.normal(size=shape(x=1)), "V": rng.normal(size=shape(y=1)), "W": rng.normal(size=shape(z=1))}
    data |= {"PH": rng.normal(size=shape(z=1)), "PHB": 9.81 * 1000 * np.arange(nz + 1)[None, :, None, None] * np.ones(shape(z=1))}
    data |= {"XLAT": rng.normal(size=(2, ny, nx)), "XLONG": rng.normal(size=(2, ny, nx))}
    path = str(tmp_path / "wrfout.npz")
    np.savez(path, **data)
    v = extract.read_native(path, {"timeidx": 0, "j_start": 1})
    assert v["t"].shape == (nx, ny - 1, nz)
    p = data["P"][0, 1, 2, 3] + 9e4
    assert v["p"][3, 1, 1] == pytest.approx(p)
    assert v["t"][3, 1, 1] == pytest.approx((data["T"][0, 1, 2, 3] + 300) * (p / 1e5) ** (2 / 7))
    assert v["u"][3, 1, 1] == pytest.approx((data["U"][0, 1, 2, 3] + data["U"][0, 1, 2, 4]) / 2)
    assert v["v"][3, 1, 1] == pytest.approx((data["V"][0, 1, 2, 3] + data["V"][0, 1, 3, 3]) / 2)
    assert v["w"][3, 1, 1] == pytest.approx((data["W"][0, 1, 2, 3] + data["W"][0, 2, 2, 3]) / 2)
    lat, lon, z = extract.geometry_native(path)
    assert lat.shape == lon.shape == (ny, nx) and z.shape == (nz, ny, nx)
    assert z[0, 0, 0] == pytest.approx(500 + data["PH"][-1, :2, 0, 0].sum() / 2 / 9.81)


def test_noise_is_that_of_one_generator(spark):
    from cirrostrat.operators import ensemble

    want = np.random.default_rng(45).normal(0.0, np.sqrt(5.0), (4, 3, 2)).astype(np.float32)
    got = ensemble.noise_field(spark, (4, 3, 2), 3, 5.0).collect()
    assert len(got) == 24 and all(r.noise == want[r.i, r.j, r.k] for r in got)
