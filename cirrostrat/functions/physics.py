"""Forward operator, localisation weights and geometry as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reflectivity operator: constants of the hydrometeor size distributions.
PI = 3.14159265358979
RD = 287.0
NOR, NOS, NOG = 8.0e6, 2.0e6, 4.0e6
ROR, ROS, ROG, ROI = 1000.0, 100.0, 913.0, 917.0
KI2, KR2 = 0.176, 0.930
MELTING = 273.16
FLOOR_DBZ = -20.0

_SCALE = 1.0e18 * 720.0
_PIP = PI**1.75
RAIN = _SCALE / (_PIP * NOR**0.75 * ROR**1.75)
DRY_SNOW = _SCALE * KI2 * ROS**0.25 / (_PIP * KR2 * NOS**0.75 * ROI**2)
WET_SNOW = _SCALE / (_PIP * NOS**0.75 * ROS**1.75)
GRAUPEL = (_SCALE / (_PIP * NOG**0.75 * ROG**1.75)) ** 0.95

#: Squared support of the localisation function, in units of its scale.
SUPPORT2 = (2.0 * math.sqrt(10.0 / 3.0)) ** 2
EARTH_KM = 6371.0
#: A scale up to this disables its axis.
NO_SCALE = 1e-6


def _positive(x: Column) -> Column:
    """Greater than 0; false for null and nan (which Spark orders above all numbers)."""
    return F.coalesce((x > 0) & ~F.isnan(x), F.lit(False))


def reflectivity(qr: Column, qs: Column, qg: Column, t: Column, p: Column) -> Column:
    """Radar reflectivity in dBZ, -20 at least. A null or nan mixing ratio adds nothing; a sum that is
    not a number is -20."""
    density = p / (t * RD)
    rain = F.when(_positive(qr), F.pow(density * qr, F.lit(1.75)) * RAIN).otherwise(0.0)
    snow = F.when(_positive(qs), F.pow(density * qs, F.lit(1.75)) * F.when(t <= MELTING, DRY_SNOW).otherwise(WET_SNOW)).otherwise(0.0)
    graupel = F.when(_positive(qg), F.pow(density * qg, F.lit(1.6625)) * GRAUPEL).otherwise(0.0)
    total = rain + snow + graupel
    return F.when(_positive(total), F.greatest(F.log10(total) * 10.0, F.lit(FLOOR_DBZ))).otherwise(FLOOR_DBZ)


def reflectivity_of(qr, qs, qg, t, p):
    """The same of numpy arrays."""
    with np.errstate(all="ignore"):
        density = p / (t * RD)
        part = lambda q, power, factor: np.where(q > 0, np.power(density * np.where(q > 0, q, 0.0), power) * factor, 0.0)
        total = part(qr, 1.75, RAIN) + part(qs, 1.75, np.where(t <= MELTING, DRY_SNOW, WET_SNOW)) + part(qg, 1.6625, GRAUPEL)
        return np.where(total > 0, np.maximum(10.0 * np.log10(np.where(total > 0, total, 1.0)), FLOOR_DBZ), FLOOR_DBZ)


def h(frame: str = "") -> Column:
    """Reflectivity of a frame's own columns; frame: a prefix of their names."""
    return reflectivity(*(F.col(f"{frame}{x}") for x in ("qr", "qs", "qg", "t", "p")))


def distance2(dx: Column, dy: Column, dz: Column, lx: Column, ly: Column, lz: Column) -> Column:
    """Squared distance in localisation scales; an axis without scale (null or up to 1e-6) adds nothing."""
    term = lambda d, s: F.when(s > NO_SCALE, F.pow(d / s, F.lit(2.0))).otherwise(0.0)
    return term(dx, lx) + term(dy, ly) + term(dz, lz)


def cutoff2(lx: Column, ly: Column, lz: Column, kind: str = "reference") -> Column:
    """What the squared distance is held against in an update. reference: the support times the largest
    scale (a number of km); consistent: the squared support."""
    if kind == "consistent":
        return F.lit(SUPPORT2)
    if kind != "reference":
        raise ValueError("cutoff: reference or consistent")
    return F.greatest(*(F.coalesce(x, F.lit(0.0)) for x in (lx, ly, lz))) * math.sqrt(SUPPORT2)


def weight(d2: Column) -> Column:
    """Localisation weight of the metrics: a Gauss curve with compact support."""
    return F.when(d2 <= SUPPORT2, F.exp(d2 * -0.5)).otherwise(0.0)


def localised_error(r: Column, d2: Column) -> Column:
    """Observation-error variance as a point at that distance sees it."""
    return r / F.greatest(F.exp(d2 * -0.5), F.lit(1e-6))


def east_north_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """Equirectangular offsets from point 1 to point 2."""
    middle = (F.radians(lat1) + F.radians(lat2)) / 2
    return F.radians(lon2 - lon1) * F.cos(middle) * EARTH_KM, (F.radians(lat2) - F.radians(lat1)) * EARTH_KM


def likelihood(d: Column, r: Column) -> Column:
    return F.exp(d * d * -0.5 / r)


def percent_change(after: Column, before: Column, least: Column) -> Column:
    """Change of an error's size in percent, held to -100..100; null where the error before is below least."""
    change = (F.abs(after) - F.abs(before)) / F.abs(before) * 100.0
    return F.when(F.abs(before) >= least, F.least(F.greatest(change, F.lit(-100.0)), F.lit(100.0)))


def innovation_reduction(before: Column, after: Column) -> Column:
    return (F.lit(1.0) - F.abs(after) / F.greatest(F.abs(before), F.lit(1e-6))) * 100.0


def normalised_innovation(d: Column, spread: Column) -> Column:
    return d / F.greatest(spread, F.lit(0.1))


def quality_pass(yo: Column, most: Column, *, dbz_min: float = 5.0, filter_ensemble: bool = True, filter_truth: bool = False, mode: str = "and") -> Column:
    """Whether an observation is used. With both filters on, mode 'and' drops it if either fails, 'or' if both fail."""
    mode = mode.lower()
    if mode not in ("and", "or"):
        raise ValueError("mode: and or or")
    tests = [*([most >= dbz_min] if filter_ensemble else []), *([yo >= dbz_min] if filter_truth else [])]
    if not tests:
        return F.lit(True)
    out = tests[0]
    for t in tests[1:]:
        out = (out & t) if mode == "and" else (out | t)
    return F.coalesce(out, F.lit(False))
