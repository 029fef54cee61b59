"""Classic netCDF files written here by the format's description, and member files as a data source."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat.schema import POINT, VARIABLES
from cirrostrat.sources import extract, members, netcdf

CODES = {"f4": 5, "f8": 6, "i2": 3, "i4": 4}


def write(path, dims, variables, *, version=1, records=0):
    """dims: name to length (0: unlimited); variables: name to (dims, array, attributes)."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    listed = lambda tag, parts: struct.pack(">ii", tag if parts else 0, len(parts)) + b"".join(parts)
    names = list(dims)

    def attributes(given):
        parts = []
        for n, v in given.items():
            v = np.atleast_1d(v)
            data = v.astype(v.dtype.newbyteorder(">")).tobytes()
            parts.append(name(n) + struct.pack(">ii", CODES[v.dtype.str[1:]], len(v)) + data + b"\0" * (-len(data) % 4))
        return listed(12, parts)

    raw = {}
    for n, (ds, a, _) in variables.items():
        data = a.astype(a.dtype.newbyteorder(">"))
        raw[n] = [data[r].tobytes() for r in range(records)] if dims[ds[0]] == 0 else [data.tobytes()]
    padded = lambda b: b + b"\0" * (-len(b) % 4)
    moving = [n for n, (ds, *_) in variables.items() if dims[ds[0]] == 0]
    fixed = [n for n in variables if n not in moving]

    def header(begin):
        parts = [name(n) + struct.pack(">i", len(ds)) + b"".join(struct.pack(">i", names.index(d)) for d in ds) + attributes(at) + struct.pack(">ii", CODES[a.dtype.str[1:]], len(padded(raw[n][0]))) + struct.pack(">q" if version == 2 else ">i", begin.get(n, 0)) for n, (ds, a, at) in variables.items()]
        return b"CDF" + bytes([version]) + struct.pack(">i", records) + listed(10, [name(n) + struct.pack(">i", v) for n, v in dims.items()]) + attributes({}) + listed(11, parts)

    at, begin = len(header({})), {}
    body = b""
    for n in fixed:
        begin[n] = at + len(body)
        body += padded(raw[n][0])
    pad = padded if len(moving) > 1 else (lambda b: b)
    for n in moving:
        begin[n] = at + len(body) + sum(len(pad(raw[o][0])) for o in moving[: moving.index(n)])
    for r in range(records):
        body += b"".join(pad(raw[n][r]) for n in moving)
    path.write_bytes(header(begin) + body)


@pytest.mark.parametrize("version", [1, 2])
def test_variables(tmp_path, version):
    rng = np.random.default_rng(1)
    fixed, moving, odd = rng.normal(size=(3, 5)).astype("f8"), rng.normal(size=(4, 3, 5)).astype("f4"), rng.integers(-99, 99, (4, 3)).astype("i2")
    moving[1, 2, 3] = netcdf.FILLS["f4"]
    odd[2, 1] = -77
    write(tmp_path / "a.nc", {"time": 0, "y": 3, "x": 5}, {"fixed": (("y", "x"), fixed, {}), "moving": (("time", "y", "x"), moving, {}), "odd": (("time", "y"), odd, {"_FillValue": np.int16(-77), "scale_factor": np.float64(0.5), "add_offset": np.float64(10)})}, version=version, records=4)
    assert netcdf.is_classic(str(tmp_path / "a.nc"))
    f = netcdf.File(str(tmp_path / "a.nc"))
    assert f.dimensions == {"time": 4, "y": 3, "x": 5}
    assert np.array_equal(f["fixed"][1:, ::2], fixed[1:, ::2])
    got = f["moving"][:]
    assert got.mask.sum() == 1 and got.mask[1, 2, 3] and np.array_equal(got.filled(0)[0], moving[0])
    packed = f["odd"][:]
    assert packed.mask.sum() == 1 and packed[3, 2] == odd[3, 2] * 0.5 + 10
    f.close()
    one = rng.normal(size=(3, 5)).astype("f4")
    write(tmp_path / "b.nc", {"time": 0, "x": 5}, {"only": (("time", "x"), one, {})}, version=version, records=3)
    assert np.array_equal(netcdf.File(str(tmp_path / "b.nc"))["only"][2], one[2])
    assert not netcdf.is_classic(__file__)


def post(path, seed):
    rng = np.random.default_rng(seed)
    data = {n: rng.normal(size=(1, 3, 4, 5)).astype("f4") for n in extract.POST_NAMES.values()}
    j, i = np.indices((4, 5))
    grid = {"XLAT": (("y", "x"), (-35 + 0.02 * j).astype("f8"), {}), "XLONG": (("y", "x"), (-60 + 0.02 * i).astype("f8"), {}), "level_z": (("z",), np.array([250.0, 500.0, 1000.0]), {})}
    write(path, {"time": 0, "z": 3, "y": 4, "x": 5}, {**{n: (("time", "z", "y", "x"), a, {}) for n, a in data.items()}, **grid}, version=2, records=1)
    return data


def native(path, seed):
    rng = np.random.default_rng(seed)
    shape = {"": (2, 2, 3, 4), "U": (2, 2, 3, 5), "V": (2, 2, 4, 4), "W": (2, 3, 3, 4)}
    data = {n: rng.normal(size=shape.get(n, shape["W" if n in ("PH", "PHB") else ""])).astype("f4") for n in ("QGRAUP", "QRAIN", "QSNOW", "T", "P", "PB", "U", "V", "W", "PH", "PHB")}
    data["PB"] += np.float32(9e4)
    dims = {"time": 0, "z": 2, "y": 3, "x": 4, "zf": 3, "yf": 4, "xf": 5}
    names = {"U": ("time", "z", "y", "xf"), "V": ("time", "z", "yf", "x"), "W": ("time", "zf", "y", "x"), "PH": ("time", "zf", "y", "x"), "PHB": ("time", "zf", "y", "x")}
    flat = {n: (("time", "y", "x"), rng.normal(size=(2, 3, 4)).astype("f4"), {}) for n in ("XLAT", "XLONG")}
    write(path, dims, {**{n: (names.get(n, ("time", "z", "y", "x")), a, {}) for n, a in data.items()}, **flat}, records=2)
    return data


def test_readers_of_true_files(spark, tmp_path):
    data = post(tmp_path / "p.nc", 1)
    v = extract.read_post(str(tmp_path / "p.nc"), {"k_start": 1, "i_end": 3})
    assert v["qr"].shape == (3, 4, 2)
    assert v["qr"][2, 1, 0] == pytest.approx(float(data["QRAIN"][0, 1, 1, 2]) * 1e-3) and v["p"][0, 3, 1] == pytest.approx(float(data["PRESSURE"][0, 2, 3, 0]) * 100)
    assert extract.nearest_in_file(spark, str(tmp_path / "p.nc"), -34.959, -59.941) == (2, 3)
    data = native(tmp_path / "wrfout", 2)
    v = extract.read_native(str(tmp_path / "wrfout"), {"timeidx": 0, "j_start": 1, "i_end": -1})
    assert v["u"].shape == (3, 2, 2)
    assert v["u"][2, 0, 1] == pytest.approx((data["U"][0, 1, 1, 2] + data["U"][0, 1, 1, 3]) / 2)
    assert v["v"][0, 1, 1] == pytest.approx((data["V"][0, 1, 2, 0] + data["V"][0, 1, 3, 0]) / 2)
    assert v["w"][0, 1, 1] == pytest.approx((data["W"][0, 1, 2, 0] + data["W"][0, 2, 2, 0]) / 2)
    lat, _, z = extract.geometry_native(str(tmp_path / "wrfout"))
    assert lat.shape == (3, 4) and z.shape == (2, 3, 4)


@pytest.mark.parametrize("kind", ["post", "wrfout"])
def test_data_source_reads_the_box_it_needs(spark, tmp_path, kind):
    for m in (0, 1, 3):
        (post if kind == "post" else native)(tmp_path / f"{m}.nc", m)
    paths = [(m, f"{tmp_path}/{m}.nc") for m in range(4)]  # one is missing
    subset = {"j_start": 1}
    reader = extract.FORMATS[kind][0]
    want = {r[:4]: r for r in map(tuple, extract.read_members(spark, [(str(m), p) for m, p in paths], lambda p: reader(p, subset)).select(*POINT, "m", *VARIABLES).collect())}
    shown = lambda df: {r[:4]: r for r in map(tuple, df.select(*POINT, "m", *VARIABLES).collect())}
    df = members.read(spark, paths, kind=kind, subset=subset, points=6)
    assert shown(df) == want
    some = members.read(spark, paths, kind=kind, subset=subset, points=6).where("m in (1, 3) and k = 1 and i >= 1 and i < 3 and j <= 0 and t is not null")
    assert shown(some) == {k: v for k, v in want.items() if k[3] in (1, 3) and k[2] == 1 and 1 <= k[0] < 3 and k[1] == 0}
    assert some.rdd.getNumPartitions() == 2 < df.rdd.getNumPartitions()
    assert members.read(spark, paths, kind=kind).where("k > 99").count() == 0
    assert df.groupBy("m").agg(F.count("t")).count() == 3
