"""Member files as a data source: ``spark.read.format("ensemble_members")``.

Options: ``kind`` (post, wrfout or npz), ``paths`` (a JSON list of [member,
path]), ``subset`` (JSON, as a job's ``subset_3d``) and ``points`` (grid points of
a partition, 65,536). The shape comes from a probe of the first file that is
there. A partition is a slab of one file: whole levels, or rows of a level.

Filters on i, j, k and m become the box that is read and the files that are
opened. Spark asks for ``spark.sql.python.filterPushdown.enabled`` to be on for a
source that does so; ``read`` turns it on. Files that aren't there have no rows and a
warning. Columns: i, j, k (from 0 in the subset), m and the variables.
"""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..schema import POINT, STATE, VARIABLES
from . import extract

NAME = "ensemble_members"
#: Grid points of a partition.
POINTS = 1 << 16


@dataclass
class Slab(InputPartition):
    member: int
    path: str
    ranges: dict  # axis: (first, end), in the subset


class MemberReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.kind = options.get("kind", "post")
        self.paths = [(int(m), p) for m, p in json.loads(options["paths"])]
        self.subset = json.loads(options.get("subset", "{}"))
        self.points = int(options.get("points", POINTS))
        self.low: dict[str, int] = dict.fromkeys(POINT, 0)
        self.end: dict[str, int | None] = dict.fromkeys(POINT)
        self.members: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "m" and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.members = wanted if self.members is None else self.members & wanted
            elif name in POINT and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    end = f.value + (not isinstance(f, LessThan))
                    self.end[name] = end if self.end[name] is None else min(self.end[name], end)
            else:
                yield f

    def partitions(self) -> list[Slab]:
        files = [(m, p) for m, p in self.paths if self.members is None or m in self.members]
        there = next((p for _, p in files if os.path.exists(p)), None)
        if there is None:
            return [Slab(m, p, dict.fromkeys(POINT, (0, 0))) for m, p in files]
        shape = dict(zip(POINT, extract.shape_of(there, self.kind, self.subset), strict=True))
        box = {a: (min(self.low[a], n), n if self.end[a] is None else max(self.low[a], min(self.end[a], n))) for a, n in shape.items()}
        size = {a: hi - lo for a, (lo, hi) in box.items()}
        if min(size.values()) <= 0:
            return []
        levels = max(1, self.points // (size["i"] * size["j"]))
        rows = size["j"] if levels > 1 or size["i"] * size["j"] <= self.points else max(1, self.points // size["i"])
        cuts = lambda a, step: [(n, min(n + step, box[a][1])) for n in range(*box[a], step)]
        return [Slab(m, p, {"i": box["i"], "j": j, "k": k}) for m, p in files for k in cuts("k", levels) for j in cuts("j", rows)]

    def read(self, partition: Slab | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no partitions
            return
        if not os.path.exists(partition.path):
            warnings.warn(f"no file {partition.path}; member {partition.member} is missing", stacklevel=1)
            return
        v = extract.read_box(partition.path, self.kind, self.subset, partition.ranges)
        (i0, _), (j0, _), (k0, _) = (partition.ranges[a] for a in POINT)
        nx, ny, nz = v[VARIABLES[0]].shape
        i, j, k = (x.ravel().astype(np.int32) for x in np.indices((nx, ny, nz)))
        columns = [i + i0, j + j0, k + k0, np.full(len(i), partition.member, np.int32), *(v[x].astype(float).ravel() for x in VARIABLES)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if n < 4 else c) for n, c in enumerate(columns)], [*POINT, "m", *VARIABLES])


class MemberSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return STATE

    def reader(self, schema: StructType) -> MemberReader:
        return MemberReader(self.options)


def read(spark: SparkSession, paths: list[tuple[int, str]], *, kind: str = "post", subset: dict | None = None, points: int = POINTS) -> DataFrame:
    """The state of all members, read slab by slab."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MemberSource)
    options = {"kind": kind, "paths": json.dumps(paths), "subset": json.dumps(subset or {}), "points": str(points)}
    return spark.read.format(NAME).options(**options).load()
