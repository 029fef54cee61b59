"""Ensemble extraction: paths, times, members and files to a state table.

Member files are described by a table of (valid time, member, path); tasks read
them. Formats: ``npz`` (arrays named as the variables, axes x, y, z), ``post``
(post-processed files, with units of their own) and ``wrfout`` (native model
output, from which temperature, pressure, height and winds at mass points are
derived). Files of the classic netCDF format are read by ``sources.netcdf``,
those of netCDF-4 by the netCDF4 library if there is one; a ``.npz`` archive with
the same names and axes is read as such a file too.

``job`` runs a configuration over all its times; ``python -m
cirrostrat.sources.extract --config FILE`` does so from a command line. Its key
``cross_sections_job`` has ``format``, ``paths`` {pattern, output, init_date,
end_date, freq, date_fmt, start}, ``ensemble`` {mem_ini, mem_end, pad} and
``subset_3d`` {timeidx, and k, j and i with _start and _end}.
"""

from __future__ import annotations

import argparse
import os
import struct
import warnings
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import say, set_verbosity
from ..schema import POINT, VARIABLES
from . import netcdf

#: Factors from the units of post-processed files to SI: g/kg and hPa.
POST_FACTORS = {"qr": 1e-3, "qs": 1e-3, "qg": 1e-3, "p": 100.0}
#: Names of the variables in post-processed files.
POST_NAMES = {"qg": "QGRAUP", "qr": "QRAIN", "qs": "QSNOW", "t": "T", "p": "PRESSURE", "u": "Umet", "v": "Vmet", "w": "W"}
#: Fixed values of the model: base temperature (K), reference pressure (Pa), R/cp, gravity (m/s2).
BASE_T, P0, KAPPA, GRAVITY = 300.0, 1e5, 2.0 / 7.0, 9.81
DATES = "%Y-%m-%d_%H:%M:%S"
#: Of a prepared file, for a task.
SLAB_BYTES = 64 << 20


def member_names(first: int, last: int, width: int = 0) -> list[str]:
    return [str(i).zfill(width) for i in range(first, last + 1)]


def valid_times(spark: SparkSession, start: str, end: str, step: str) -> DataFrame:
    """valid_time from start to end, both included. step: an interval such as '1 hour'."""
    return spark.sql("SELECT explode(sequence(to_timestamp(:a), to_timestamp(:b), make_interval(0, 0, 0, 0, 0, 0, :s))) AS valid_time", {"a": start, "b": end, "s": pd.Timedelta(step).total_seconds()})


def member_paths(pattern: str, members: list[str], when: datetime, *, init: str = "", date_format: str = "%Y-%m-%d_%H:%M:%S") -> list[tuple[str, str]]:
    """(member, path); the pattern's tokens are {member}, {date} and {init}."""
    date = when.strftime(date_format)
    return [(m, pattern.format(member=m, date=date, init=init)) for m in members]


def read_npz(path: str) -> dict[str, np.ndarray]:
    """Variables of a member as (nx, ny, nz)."""
    with np.load(path) as f:
        return {x: f[x] for x in VARIABLES}


class _Archive(dict):
    """Arrays by name, opened and closed like a file."""

    def close(self) -> None:
        self.clear()


def open_arrays(path: str):
    """Variables by name, indexed as arrays."""
    if path.endswith(".npz"):
        with np.load(path) as f:
            return _Archive({n: f[n] for n in f.files})
    if netcdf.is_classic(path):
        return netcdf.File(path)
    try:
        from netCDF4 import Dataset
    except ImportError as e:
        raise RuntimeError("files of netCDF-4 need the netCDF4 library") from e
    data = Dataset(path)
    return _Opened(data)


class _Opened:
    def __init__(self, data) -> None:
        self.data = data

    def __getitem__(self, name: str):
        return self.data.variables[name]

    def close(self) -> None:
        self.data.close()


def slices_of(subset: dict | None) -> tuple[slice, slice, slice]:
    """Slices of the levels, rows and columns."""
    subset = subset or {}
    return tuple(slice(subset.get(f"{a}_start"), subset.get(f"{a}_end")) for a in "kji")


def _numbers(x) -> np.ndarray:
    return np.ma.filled(np.ma.asarray(x, dtype=float), np.nan)


def read_post(path: str, subset: dict | None = None) -> dict[str, np.ndarray]:
    """Variables of a post-processed file, first time, in SI units, as (nx, ny, nz); masked values are nan."""
    data = open_arrays(path)
    try:
        at = (0, *slices_of(subset))
        return {x: _numbers(data[n][at]).T * POST_FACTORS.get(x, 1.0) for x, n in POST_NAMES.items()}
    finally:
        data.close()


def _centred(x: np.ndarray, axis: int) -> np.ndarray:
    """From the faces of cells to their centres."""
    lo, hi = [slice(None)] * x.ndim, [slice(None)] * x.ndim
    lo[axis], hi[axis] = slice(None, -1), slice(1, None)
    return 0.5 * (x[tuple(lo)] + x[tuple(hi)])


def read_native(path: str, subset: dict | None = None) -> dict[str, np.ndarray]:
    """Variables of native model output at one time (key timeidx, the last by default), as (nx, ny, nz)."""
    data = open_arrays(path)
    try:
        time = (subset or {}).get("timeidx", -1)
        k, j, i = (slice(*s.indices(n)[:2]) for s, n in zip(slices_of(subset), data["P"].shape[1:], strict=True))
        face = lambda s: slice(s.start, s.stop + 1)  # noqa: E731  the cells' faces: one more
        get = lambda n, k=k, j=j, i=i: _numbers(data[n][time, k, j, i])
        p = get("P") + get("PB")
        v = {
            "qg": get("QGRAUP"), "qr": get("QRAIN"), "qs": get("QSNOW"),
            "t": (get("T") + BASE_T) * (p / P0) ** KAPPA, "p": p,
            "u": _centred(get("U", i=face(i)), 2), "v": _centred(get("V", j=face(j)), 1), "w": _centred(get("W", k=face(k)), 0),
        }
        return {x: a.T for x, a in v.items()}
    finally:
        data.close()


def geometry_post(path: str, subset: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latitudes and longitudes (ny, nx) and heights in metres (nz, ny, nx) of a post-processed file; its levels are flat."""
    data = open_arrays(path)
    try:
        k, j, i = slices_of(subset)
        lat, lon = (_numbers(data[n][j, i]) for n in ("XLAT", "XLONG"))
        levels = _numbers(data["level_z"][k])
        return lat, lon, np.broadcast_to(levels[:, None, None], (len(levels), *lat.shape)).copy()
    finally:
        data.close()


def geometry_native(path: str, subset: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of native model output."""
    data = open_arrays(path)
    try:
        time = (subset or {}).get("timeidx", -1)
        k, j, i = slices_of(subset)
        height = _centred((_numbers(data["PH"][time]) + _numbers(data["PHB"][time])) / GRAVITY, 0)
        return _numbers(data["XLAT"][time])[j, i], _numbers(data["XLONG"][time])[j, i], height[k, j, i]
    finally:
        data.close()


#: Readers of a member and of the geometry, by format.
FORMATS = {"post": (read_post, geometry_post), "wrfout": (read_native, geometry_native)}


def shape_of(path: str, kind: str, subset: dict | None = None) -> tuple[int, int, int]:
    """Points along i, j and k of a file's subset, from its header."""
    if kind == "npz":
        return read_npz(path)[VARIABLES[0]].shape
    data = open_arrays(path)
    try:
        whole = data[POST_NAMES["t"] if kind == "post" else "P"].shape[1:]
        return tuple(len(range(n)[s]) for s, n in zip(slices_of(subset), whole, strict=True))[::-1]
    finally:
        data.close()


def read_box(path: str, kind: str, subset: dict | None, ranges: dict[str, tuple[int, int]]) -> dict[str, np.ndarray]:
    """Variables of a box of a file's subset; ranges: first and end along i, j and k."""
    if kind == "npz":
        return {x: v[tuple(slice(*ranges[a]) for a in POINT)] for x, v in read_npz(path).items()}
    data = open_arrays(path)
    try:
        whole = data[POST_NAMES["t"] if kind == "post" else "P"].shape[1:]
    finally:
        data.close()
    own = dict(subset or {})
    for axis, s, n in zip("kji", slices_of(subset), whole, strict=True):
        first = s.indices(n)[0]
        own |= {f"{axis}_start": first + ranges[axis][0], f"{axis}_end": first + ranges[axis][1]}
    return FORMATS[kind][0](path, own)


def geometry_table(spark: SparkSession, path: str, kind: str, subset: dict | None = None) -> DataFrame:
    """i, j, k, lat, lon and z_m, read by one task a level at a time; neighbours.positions makes kilometres of them."""
    probe = FORMATS[kind][1]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["path"]:
                lat, lon, z = probe(name, subset)
                j, i = (x.ravel().astype(np.int32) for x in np.indices(lat.shape))
                for k, level in enumerate(z):
                    yield pd.DataFrame({"i": i, "j": j, "k": np.int32(k), "lat": lat.ravel(), "lon": lon.ravel(), "z_m": level.ravel()})

    return spark.createDataFrame([(path,)], "path string").mapInPandas(rows, "i int, j int, k int, lat double, lon double, z_m double")


def nearest_in_file(spark: SparkSession, path: str, lat: float, lon: float, *, kind: str = "post") -> tuple[int, int]:
    """(j, i) of the point of a file that is nearest to a place."""
    from ..operators import neighbours

    points = geometry_table(spark, path, kind).where("k = 0")
    found = neighbours.nearest(points, spark.createDataFrame([("here", float(lat), float(lon))], "name string, lat double, lon double")).first()
    return int(found.j), int(found.i)


def _fields(*names: str) -> str:
    return ", ".join([*names, *(f"{c} int" for c in (*POINT, "m")), *(f"{x} double" for x in VARIABLES)])


def read_members(spark: SparkSession, paths: list[tuple[str, str]], read: Callable[[str], dict[str, np.ndarray]] = read_npz) -> DataFrame:
    """The state of all members: i, j, k, m and variables. A path that isn't there is passed over with a warning."""
    table = spark.createDataFrame([(n, p) for n, (_, p) in enumerate(paths)], "m int, path string")
    return _read(table.repartition(max(1, len(paths))), read, _fields())


def _read(table: DataFrame, read: Callable[[str], dict[str, np.ndarray]], fields: str) -> DataFrame:
    """The members of a table of m, path and more columns, which go along; a task reads a member an i-slab at a time."""
    more = [c for c in table.columns if c not in ("m", "path")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for member in b.itertuples(index=False):
                if not os.path.exists(member.path):
                    warnings.warn(f"no file {member.path}; member {member.m} is missing", stacklevel=1)
                    continue
                v = read(member.path)
                nx, ny, nz = v[VARIABLES[0]].shape
                j, k = (x.ravel().astype(np.int32) for x in np.indices((ny, nz)))
                for i in range(nx):
                    yield pd.DataFrame({**{c: getattr(member, c) for c in more}, "i": np.int32(i), "j": j, "k": k, "m": np.int32(member.m), **{x: v[x][i].astype(float).ravel() for x in VARIABLES}})

    return table.mapInPandas(rows, fields)


def job_members(spark: SparkSession, config: dict) -> DataFrame:
    """valid_time, m, member and path of all members at all times of a job."""
    paths, ensemble = config["paths"], config["ensemble"]
    pattern = paths.get("pattern") or paths.get("template")
    if pattern is None or paths.get("init_date") is None or paths.get("end_date") is None:
        raise ValueError("paths: pattern, init_date and end_date are required")
    first, last = (datetime.strptime(paths[k], DATES) for k in ("init_date", "end_date"))
    times = pd.date_range(first, last, freq=str(paths.get("freq", "1h")).replace("H", "h"))
    names = member_names(ensemble["mem_ini"], ensemble["mem_end"], ensemble.get("pad", 0))
    start, form = paths.get("start", ""), paths.get("date_fmt", DATES)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for when in b["valid_time"]:
                found = member_paths(pattern, names, when.to_pydatetime(), init=start, date_format=form)
                yield pd.DataFrame({"valid_time": when, "m": np.arange(len(found), dtype=np.int32), "member": [m for m, _ in found], "path": [p for _, p in found]})

    # The driver lists times; members of a time are named by tasks.
    return spark.createDataFrame([(t,) for t in times.to_pydatetime()], "valid_time timestamp").mapInPandas(named, "valid_time timestamp, m int, member string, path string")


def job(spark: SparkSession, config: dict) -> str:
    """Extracts all members at all times to ``paths.output``: Parquet tables ``state`` (by valid_time; levels without
    any number left out), ``grid`` (kilometres; of the first file of the job that is there) and ``missing`` (members
    without a file). Tasks read the files; a time that is run again is replaced. Returns the folder."""
    from ..operators import ensemble as members
    from ..operators import neighbours

    config = config.get("cross_sections_job", config)
    kind = config.get("format", "wrfout").lower()
    if kind not in FORMATS:
        raise ValueError(f"format {kind}")
    read, subset = FORMATS[kind][0], config.get("subset_3d") or {}
    table = job_members(spark, config)
    out = config["paths"]["output"].format(date="", init=config["paths"].get("start", "")).removesuffix(".npz")
    files = table.orderBy("valid_time", "m").select("path").toLocalIterator()  # a row for each file
    there = next((r.path for r in files if os.path.exists(r.path)), None)
    if there is None:
        raise FileNotFoundError("no file of the job is there")
    say(1, "%s files to %s", kind, out)
    n = max(1, table.count())
    state = _read(table.select("valid_time", "m", "path").repartition(n, "valid_time", "m"), lambda p: read(p, subset), _fields("valid_time timestamp"))
    state = members.live_levels(state, *VARIABLES)
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("valid_time").parquet(f"{out}/state")
    neighbours.positions(geometry_table(spark, there, kind, subset)).write.mode("overwrite").parquet(f"{out}/grid")
    known = spark.read.parquet(f"{out}/state").select(F.col("valid_time").cast("timestamp").alias("valid_time"), "m").distinct()
    table.join(known, ["valid_time", "m"], "left_anti").write.mode("overwrite").parquet(f"{out}/missing")
    return out


def lattice(state: DataFrame, members: int) -> DataFrame:
    """state with a row of nulls for every point of a member that is missing."""
    points = state.select(*POINT).distinct()
    every = state.sparkSession.range(members).select(F.col("id").cast("int").alias("m"))
    return points.crossJoin(F.broadcast(every)).join(state, [*POINT, "m"], "left")


def import_prepared(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(state, grid) of a prepared .npz file: state_ensemble (nx, ny, nz, members, variables), else the older
    cross_sections; pos_km (nx, ny, nz, 3) is required. Or of a folder that ``job`` wrote, if that has one time.
    Levels without any number are left out. Tasks read slabs of the file."""
    from ..operators import ensemble as members

    if os.path.isdir(path):
        state = spark.read.parquet(f"{path}/state")
        if state.select("valid_time").distinct().limit(2).count() > 1:
            raise ValueError("several valid times; choose one folder of them")
        return state.drop("valid_time"), spark.read.parquet(f"{path}/grid")
    with np.load(path) as f:
        if "pos_km" not in f.files:
            raise KeyError("pos_km")
        name = "state_ensemble" if "state_ensemble" in f.files else "cross_sections"
    state = _slabs(spark, path, name, (*POINT, "m"), VARIABLES)
    return members.live_levels(state, *VARIABLES), _slabs(spark, path, "pos_km", POINT, ("x_km", "y_km", "z_km"))


def place_in_archive(path: str, name: str) -> tuple[np.dtype, tuple[int, ...], str, int] | None:
    """Type, shape, order and place of an array's values in an archive of arrays; None where it is compressed."""
    with zipfile.ZipFile(path) as z, open(path, "rb") as f:
        entry = z.getinfo(f"{name}.npy")
        if entry.compress_type != zipfile.ZIP_STORED:
            return None
        f.seek(entry.header_offset + 26)
        f.seek(sum(struct.unpack("<HH", f.read(4))), os.SEEK_CUR)  # over the entry's own name and extra field
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        return kind, shape, "F" if fortran else "C", f.tell()


def _slabs(spark: SparkSession, path: str, name: str, axes: tuple[str, ...], last: tuple[str, ...]) -> DataFrame:
    """An array of an archive as rows: indices along axes, and a column for each entry of the last axis. A task maps
    the file and reads its own slab of the first axis; a compressed array is read by one task, a slab at a time."""
    place = place_in_archive(path, name)
    if place:
        size = int(np.prod(place[1], dtype=np.int64)) * place[0].itemsize
        n = max(1, min(place[1][0], -(-size // SLAB_BYTES)))
    else:
        n = 1

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in b["id"]:
                if place:
                    kind, shape, order, at = place
                    data = np.memmap(path, kind, "r", at, shape, order)
                else:
                    with np.load(path) as f:
                        data = f[name]
                where = dict(zip(axes[1:], np.indices(data.shape[1:-1]).reshape(len(axes) - 1, -1).astype(np.int32), strict=True))
                for i in range(part * len(data) // n, (part + 1) * len(data) // n):
                    slab = np.asarray(data[i]).reshape(-1, data.shape[-1]).astype(float)
                    yield pd.DataFrame({axes[0]: np.int32(i), **where, **{x: slab[:, c] for c, x in enumerate(last)}})

    return spark.range(0, n, 1, n).mapInPandas(rows, ", ".join([*(f"{a} int" for a in axes), *(f"{x} double" for x in last)]))


def main(argv: list[str] | None = None) -> None:
    from . import config as configs

    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config", required=True, help="a YAML or JSON file")
    parser.add_argument("--verbose", type=int, default=1)
    args = parser.parse_args(argv)
    set_verbosity(args.verbose)
    job(SparkSession.builder.appName("cirrostrat-extract").getOrCreate(), configs.load(args.config))


if __name__ == "__main__":
    main()
