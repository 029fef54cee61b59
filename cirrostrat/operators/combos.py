"""Hyper-parameter combinations. Small driver-side tables."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..schema import COMBOS

METHODS = ("LETKF", "TEnKF", "AOEI", "ATEnKF", "TAOEI")
#: Methods whose number of steps is not a parameter.
ONE_STEP = ("LETKF", "AOEI", "ATEnKF")
#: Keys of a sweep; method is another name of methods.
KEYS = ("methods", "method", "ntemp", "alpha_s", "loc_x", "loc_y", "loc_z", "stride", "truth_members", "prior_size", "obs_points")


def expand(value, whole: bool = False) -> list:
    """A scalar, a list, or {start, stop, num} with both ends; whole: rounded and distinct, for the last form."""
    if isinstance(value, dict):
        out = np.linspace(float(value["start"]), float(value["stop"]), int(value["num"]))
        return np.unique(np.round(out)).astype(int).tolist() if whole else out.tolist()
    return list(value) if isinstance(value, (list, tuple)) else [value]


def combinations(sweep: dict) -> list[tuple]:
    """(method, ntemp, alpha_s, lx, ly, lz), distinct, in order. A null scale disables its axis. Unknown keys are errors."""
    unknown = sorted(set(sweep) - set(KEYS))
    if unknown or {"method", "methods"} <= set(sweep):
        raise ValueError(f"sweep: unknown keys {unknown}" if unknown else "sweep: either methods or method")
    scale = lambda name, default: [0.0 if v is None else float(v) for v in expand(sweep.get(name, default))]
    out: dict[tuple, None] = {}
    for method, ntemp, alpha, *scales in product(
        expand(sweep.get("methods", sweep.get("method", "TEnKF"))), expand(sweep.get("ntemp", 1), whole=True), expand(sweep.get("alpha_s", 2.0)), scale("loc_x", 10.0), scale("loc_y", 10.0), scale("loc_z", 4.0)
    ):
        if method not in METHODS:
            raise ValueError(f"method {method}")
        out[method, 1 if method in ONE_STEP else int(ntemp), float(alpha), *scales] = None
    return list(out)


def combo_table(spark: SparkSession, sweep: dict) -> DataFrame:
    return spark.createDataFrame([(n, *c) for n, c in enumerate(combinations(sweep))], COMBOS)
