"""Metrics of analyses with one observation each, over a domain of any size.

Observations are dealt to parts of the domain of about MOST_POINTS grid points
each, and grid points are repeated to the parts that they are in reach of: the
few around an edge twice, the others once. So what is shuffled is the ensemble,
with a row for each point, and not a row for each observation, point of its zone
and member. A part's observations and points meet in one numpy kernel, which
pairs them, goes through the steps of every combination and sums each
observation's metrics, in blocks of observations and of pairs. Pairs that no
step updates (most of them, by the reference's cutoff) are summed once for all
combinations of the same scales, as they stay what they were.

The formulas are those of ``single_obs``, null for null: the observed ensemble
before each step follows from the observation's own point; mean, variance and
errors that depend on them are those of the members that the point and the
observation both have.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import folders
from ..functions import physics, tempering
from ..schema import POINT, REFLECTIVITY_INPUTS, VARIABLES
from . import multi_obs, steps

#: Observations that are paired at once, and values (pairs x members x variables) that are worked on at once.
OBSERVATIONS, BLOCK = 256, 1 << 17
#: Observations that are held against the points between them along x.
NEAR = 64
NAMES = (*VARIABLES, "ref")
#: A kernel's columns of a row: hxa_mean, hxf_mean, then for each quantity and f and a: error and spread, weighted too.
OUT = ("hxa_mean", "hxf_mean", *(c for x in NAMES for t in "fa" for c in (f"rmse_{t}_{x}", f"spread_{t}_{x}", f"rmse_{t}_w_{x}", f"spread_{t}_w_{x}")))
OBS = ("obs_id", "yo", "yo_clean", "i", "j", "k")
#: Tasks of the kernel for each core, and the parts that a task has at most (unless hashes of parts meet).
WAVES, PARTS = 4, 32


def _held(v: np.ndarray, there: np.ndarray | None) -> np.ndarray:
    return v if there is None else np.where(there, v, 0.0)


def _count(v: np.ndarray, there: np.ndarray | None) -> np.ndarray:
    return np.full((*v.shape[:-2], v.shape[-1]), v.shape[-2]) if there is None else there.sum(axis=-2)


def _moments(v: np.ndarray, there: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and spread over the members [..., members, rows] that are there, and their number."""
    n = _count(v, there)
    mean = _held(v, there).sum(axis=-2) / n
    dev = _held(v - mean[..., None, :], there)
    return mean, np.sqrt((dev * dev).sum(axis=-2) / np.where(n > 1, n - 1, np.nan)), n


def _reflectivity(x: np.ndarray, there: np.ndarray | None) -> np.ndarray:
    values = (x[VARIABLES.index(v)] if there is None else np.where(there[VARIABLES.index(v)], x[VARIABLES.index(v)], np.nan) for v in REFLECTIVITY_INPUTS)
    return physics.reflectivity_of(*values)


def _weights(ntemp: int, alpha: float) -> np.ndarray:
    """Weights of all steps of a schedule, as tempering.step_weight gives them."""
    raw = np.exp(-(ntemp + 1) * alpha / np.arange(1, ntemp + 1))
    return np.ones(1) if ntemp <= 1 else raw / raw.sum()


class _Schedule:
    """Errors of the steps of one combination."""

    def __init__(self, method: str, ntemp: int, alpha: float, most: int):
        self.method, self.own, self.alpha = method, None, alpha
        self.steps = min(most, {"LETKF": 1, "AOEI": 1, "ATEnKF": tempering.MOST_STEPS}.get(method, ntemp))
        self.weights = _weights(ntemp, alpha) if method in ("TEnKF", "TAOEI") else np.ones(1)
        #: Schedules with the same key have the same errors: LETKF and TEnKF of one step, say.
        self.key = (method == "ATEnKF" and alpha, method in ("AOEI", "TAOEI"), self.steps, *self.weights)

    def error(self, step: int, r0: np.ndarray, adaptive: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Error of a step (from 0), nan where the observation is not used in it, and the steps that ATEnKF needs."""
        if self.method == "ATEnKF":
            every = [_weights(n, self.alpha) for n in range(1, tempering.MOST_STEPS + 1)]
            if own is None:
                ratio = adaptive / np.maximum(r0, 1e-30)
                own = np.full(len(r0), tempering.MOST_STEPS)
                for n in range(tempering.MOST_STEPS, 0, -1):
                    own = np.where(every[n - 1][0] <= 1.0 / ratio + 1e-9, n, own)
                own = np.where(ratio <= 1.0 + 1e-6, 1, own)
            share = np.array([w[step] if len(w) > step else np.nan for w in every])
            return r0 / share[own - 1], own
        return (adaptive if self.method in ("AOEI", "TAOEI") else r0) / self.weights[step], own


def _step(x, there, y, seen, yo, r0, d2, updated, schedule: _Schedule, step: int, own):
    """One step. x [variables, members, rows] with what is there; y [members, rows] with what the observation and the
    row both have (seen). None: all. Returns x, what is there, and the steps that each row needs."""
    n = _count(y, seen)
    mean = _held(y, seen).sum(axis=0) / n
    dy = _held(y - mean, seen)
    var = (dy * dy).sum(axis=0) / np.where(n > 1, n - 1, np.nan)
    adaptive = np.where(n > 1, np.maximum(r0, (yo - mean) ** 2 - var), r0)
    r, own = schedule.error(step, r0, adaptive, own)
    local = r / np.maximum(np.exp(-0.5 * d2), 1e-6)
    factor = dy / var * (np.sqrt(local / (local + var)) - 1.0) + (yo - mean) / (local + var)
    go = updated & ~np.isnan(r) & (var > 0)
    if there is None and seen is None:
        cov = ((x - x.mean(axis=1, keepdims=True)) * dy).sum(axis=1) / (n - 1)
        return x + np.where(go, cov, 0.0)[:, None, :] * np.where(go, factor, 0.0), None, own
    both = np.broadcast_to(seen, x.shape) if there is None else there if seen is None else there & seen
    pairs = both.sum(axis=1)
    dx = np.where(both, x - (np.where(both, x, 0.0).sum(axis=1) / pairs)[:, None, :], 0.0)
    cov = (dx * np.where(both, dy, 0.0)).sum(axis=1) / np.where(pairs > 1, pairs - 1, np.nan)
    x = np.where(go, x + cov[:, None, :] * factor, x)
    return x, np.where(go, both & (pairs > 1)[:, None, :], both | (there if there is not None else True)), own


class _Points:
    """The grid points of a part as dense arrays; there: which values are (None: all)."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        column = lambda c: t.column(c).combine_chunks() if not isinstance(t.column(c), pa.Array) else t.column(c)
        number = lambda c: column(c).to_numpy(zero_copy_only=False).astype(float)
        at = np.stack([number(c) for c in ("gx", "gy", "gz")])
        order = np.argsort(at[0], kind="stable")
        self.at, self.index = at[:, order], np.stack([number(c) for c in ("gi", "gj", "gk")])[:, order]
        ms = column("ms")
        row = np.repeat(np.arange(len(ms)), np.diff(ms.offsets.to_numpy()))
        known, place = np.unique(ms.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        dense = np.full((len(VARIABLES), len(known), len(ms)), np.nan)
        there, has = np.zeros(dense.shape, bool), np.zeros(dense.shape[1:], bool)
        has[place, row] = True
        for n, v in enumerate(VARIABLES):
            values = column(v).flatten()
            dense[n, place, row] = values.to_numpy(zero_copy_only=False).astype(float)
            there[n, place, row] = values.is_valid().to_numpy(zero_copy_only=False)
        self.x = dense[:, :, order]
        self.has = None if has.all() else has[:, order]
        self.there = None if there.all() else there[:, :, order]
        truth = [column(f"t_{v}") for v in NAMES]
        self.truth = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in truth])[:, order]
        self.known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in truth])[:, order]
        self.counts = column("counts").to_numpy(zero_copy_only=False).astype(bool)[order]
        self.before = self.scores(self.x, self.there, self.has, slice(None))

    def take(self, rows: np.ndarray):
        """Values, which are there, and members of rows."""
        return np.take(self.x, rows, axis=2), None if self.there is None else np.take(self.there, rows, axis=2), None if self.has is None else np.take(self.has, rows, axis=1)

    def scores(self, x, there, has, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """[quantities, rows] of rows with those values: mean minus truth, spread; and the mean reflectivity."""
        mean, spread, n = _moments(x, there)
        m_ref, s_ref, n_ref = _moments(_reflectivity(x, there), has)
        error = np.concatenate([mean, m_ref[None]]) - self.truth[:, rows]
        number = np.concatenate([n, n_ref[None]])
        # What is null has the number of an infinity, as nan is a value.
        return np.where((number > 0) & self.known[:, rows], error, np.inf), np.where(number > 1, np.concatenate([spread, s_ref[None]]), np.inf), m_ref


def _sums(error: np.ndarray, spread: np.ndarray, rho: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over runs of pairs [8, quantities, runs]: squared errors, their number, and the same of spreads, then all weighted."""
    out = []
    for w in (np.ones_like(rho), rho):
        for v in (error, spread):
            here = v != np.inf
            value = np.where(here, v, 0.0)
            out += [np.add.reduceat((value * value if v is error else value) * w, starts, axis=1), np.add.reduceat(np.where(here, w, 0.0), starts, axis=1)]
    return np.stack(out)


def _pairs(points: _Points, at: np.ndarray, scales: tuple, limit: float):
    """Pairs of observations (places at, in order of x) and points in their zones: observation, point, squared distance, whether it is updated."""
    reach = scales[0] * math.sqrt(physics.SUPPORT2) * (1 + 1e-9)
    out = []
    for first in range(0, at.shape[1], NEAR):
        few = at[:, first : first + NEAR]
        lo, hi = np.searchsorted(points.at[0], few[0, 0] - reach), np.searchsorted(points.at[0], few[0, -1] + reach, side="right")
        d2 = np.zeros((few.shape[1], hi - lo))
        for axis, s in enumerate(scales):
            if s is not None and s > physics.NO_SCALE:
                d2 += ((points.at[axis, lo:hi] - few[axis][:, None]) / s) ** 2
        place = np.flatnonzero(d2 <= physics.SUPPORT2)
        o, p = np.divmod(place, max(1, hi - lo))
        out.append((o + first, p + lo, d2.ravel()[place]))
    o, p, d2 = (np.concatenate(c) for c in zip(*out, strict=True))
    return o, p, d2, d2 <= limit


def _add_sums(total: np.ndarray, o: np.ndarray, error: np.ndarray, spread: np.ndarray, d2: np.ndarray) -> None:
    """Adds the sums of pairs, in order of their observations o, to total [8, quantities, observations]."""
    if len(o):
        starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        total[:, :, o[starts]] += _sums(error, spread, np.exp(-0.5 * d2), starts)


class _Zones:
    """Pairs of a block of observations under one set of scales, and what all schedules share: sums before the analysis
    (before) and those of the pairs that no step updates (still, [8, quantities, observations]), which stay as they are."""

    def __init__(self, points: _Points, obs: dict[str, np.ndarray], pairs):
        n = len(obs["yo"])
        o, p, d2, updated = pairs
        at_obs = (points.index[:, p] == obs["index"][:, o]).all(axis=0)
        own = np.full(n, -1)
        own[o[at_obs]] = np.flatnonzero(at_obs)
        #: Observations that have a point, and its place, distance and whether it is updated.
        self.here = np.flatnonzero(own >= 0)
        own = own[self.here]
        self.own, self.own_d2, self.own_updated = p[own], d2[own], updated[own]
        counted = points.counts[p]
        self.some, self.hx = np.zeros(n, bool), np.full(n, np.nan)
        self.some[o[counted]] = True
        mine = counted & at_obs
        self.hx[o[mine]] = points.before[2][p[mine]]
        self.still, self.before = np.zeros((8, len(NAMES), n)), np.zeros((8, len(NAMES), n))
        size = max(1, BLOCK // len(NAMES))
        for total, rows in ((self.still, np.flatnonzero(counted & ~updated)), (self.before, np.flatnonzero(counted & updated))):
            for lo in range(0, len(rows), size):
                r = rows[lo : lo + size]
                _add_sums(total, o[r], points.before[0][:, p[r]], points.before[1][:, p[r]], d2[r])
        self.before += self.still
        self.columns = None  # of before, once they are asked for
        moved = counted & updated
        self.o, self.p, self.d2, self.at_obs = o[moved], p[moved], d2[moved], at_obs[moved]


def _analyse(points: _Points, obs: dict[str, np.ndarray], zones: _Zones, schedule: _Schedule) -> tuple[np.ndarray, np.ndarray]:
    """For each observation: sums of _sums after the analysis [8, quantities, observations], and its mean reflectivity."""
    n, members, here = len(obs["yo"]), points.x.shape[1], zones.here
    # The observed ensemble before each step; a member that the observation's point lacks has none.
    x, there, has = points.take(zones.own)
    seen = None
    if has is not None or len(here) < n:
        seen = np.zeros((members, n), bool)
        seen[:, here] = True if has is None else has
    ys, needs = [], None
    for s in range(schedule.steps):
        y = np.zeros((members, n))
        y[:, here] = _reflectivity(x, there)
        ys.append(y)
        x, there, needs = _step(x, there, y[:, here], None if seen is None else seen[:, here], obs["yo"][here], obs["r0"][here], zones.own_d2, zones.own_updated, schedule, s, needs)
    total, after = zones.still.copy(), zones.hx.copy()
    size = max(1, BLOCK // max(1, members * len(VARIABLES)))
    for lo in range(0, len(zones.o), size):
        rows = slice(lo, lo + size)
        po, pp, d2 = zones.o[rows], zones.p[rows], zones.d2[rows]
        x, there, has = points.take(pp)
        both = has if seen is None else seen[:, po] if has is None else seen[:, po] & has
        needs, updated = None, np.ones(len(po), bool)
        for s in range(schedule.steps):
            x, there, needs = _step(x, there, np.take(ys[s], po, axis=1), both, obs["yo"][po], obs["r0"][po], d2, updated, schedule, s, needs)
        error, spread, ref = points.scores(x, there, has, pp)
        _add_sums(total, po, error, spread, d2)
        mine = zones.at_obs[rows]
        after[po[mine]] = ref[mine]
    return total, after


def _column(v: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(v, mask=null) if null.any() else pa.array(v)


def _columns(total: np.ndarray, some: np.ndarray) -> list[list[pa.Array]]:
    """For each quantity error, spread and both weighted, of those observations, from sums of _sums."""
    t = total if some.all() else total[:, :, some]
    number = t[1::2]
    values, nulls = t[0::2] / number, number == 0
    values[0::2] = np.sqrt(values[0::2])
    return [[_column(values[n, q], nulls[n, q]) for n in range(4)] for q in range(len(NAMES))]


def _metrics_of(points: _Points, obs: dict[str, np.ndarray], combos: list[tuple], most: int, cutoff: str):
    """For each combination: its number, the observations that have pairs, and the columns of OUT.
    Combinations of the same scales share their pairs, those of the same errors too share all."""
    paired: dict[tuple, _Zones] = {}
    done: dict[tuple, tuple] = {}
    for combo, method, ntemp, alpha, *scales in combos:
        key, schedule = tuple(scales), _Schedule(method, ntemp, alpha, most)
        if key not in paired:
            limit = max(s or 0.0 for s in key) * math.sqrt(physics.SUPPORT2) if cutoff == "reference" else physics.SUPPORT2
            paired[key] = _Zones(points, obs, _pairs(points, obs["at"], key, limit))
        zones = paired[key]
        if (key, schedule.key) not in done:
            total, after = _analyse(points, obs, zones, schedule)
            if zones.columns is None:
                zones.columns = _columns(zones.before, zones.some)
            columns = [_column(v[zones.some], np.isnan(v[zones.some])) for v in (after, zones.hx)]
            for f, a in zip(zones.columns, _columns(total, zones.some), strict=True):
                columns += f + a
            done[key, schedule.key] = np.flatnonzero(zones.some), columns
        yield combo, *done[key, schedule.key]


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().astype(float)


def _kernel(combos: list[tuple], most: int, cutoff: str):
    names = ["obs_id", "combo_id", *OBS[1:], *OUT]

    def run(p: pa.Table, o: pa.Table) -> pa.Table:
        done = []
        points = _Points(p) if p.num_rows and o.num_rows else None
        o = o.sort_by([("x_km", "ascending"), ("obs_id", "ascending")])
        for lo in range(0, o.num_rows if points else 0, OBSERVATIONS):
            part = o.slice(lo, OBSERVATIONS)
            values = {"yo": _numbers(part, "yo"), "r0": _numbers(part, "r0"), "at": np.stack([_numbers(part, f"{a}_km") for a in "xyz"]), "index": np.stack([_numbers(part, a) for a in POINT])}
            with np.errstate(all="ignore"):
                for combo, rows, columns in _metrics_of(points, values, combos, most, cutoff):
                    kept = part.take(pa.array(rows))
                    done.append(pa.table([kept.column("obs_id"), pa.array(np.full(len(rows), combo, np.int32)), *(kept.column(c) for c in OBS[1:]), *columns], names=names))
        none = [pa.array([], pa.int32()), *(o.slice(0, 0).column(c) for c in OBS[1:]), *(pa.array([], pa.float64()) for _ in OUT)]
        return pa.concat_tables(done).combine_chunks() if done else pa.table([o.slice(0, 0).column("obs_id"), *none], names=names)

    return run


def fits(combos: DataFrame) -> bool:
    """Whether every combination has horizontal scales, so that a zone is near its observation."""
    return not combos.where((F.coalesce("lx", F.lit(0.0)) <= physics.NO_SCALE) | (F.coalesce("ly", F.lit(0.0)) <= physics.NO_SCALE)).limit(1).count()


def sweep(obs: DataFrame, combos: DataFrame, grid: DataFrame, prior: DataFrame, truth: DataFrame, *, most_steps: int, cutoff: str = "reference", most_points: int = multi_obs.MOST_POINTS) -> DataFrame:
    """A row for each observation and combination that fits: obs_id, combo_id, yo, yo_clean, i, j, k and the columns of OUT."""
    if cutoff not in ("reference", "consistent"):
        raise ValueError("cutoff: reference or consistent")
    few = [tuple(r) for r in combos.select("combo_id", "method", "ntemp", "alpha_s", "lx", "ly", "lz").collect()]
    reach = math.sqrt(physics.SUPPORT2) * max((max(r[4], r[5]) for r in few), default=1.0) * (1 + 1e-9)
    size = multi_obs.tile_size(grid, reach, most_points)
    obs = folders.kept(obs.select(*OBS, "x_km", "y_km", "z_km", "r0"), "observations")
    # An observation may stand where no point is.
    parts = folders.kept(multi_obs.parts_alone(grid.select("x_km", "y_km").unionByName(obs.select("x_km", "y_km")), size, most_points), "parts")
    # A part is much work for its bytes, so the number of tasks follows from parts and cores.
    n = parts.count()
    tasks = max(1, min(n, WAVES * grid.sparkSession.sparkContext.defaultParallelism), n // PARTS)
    edge = F.lit(size) / F.pow(F.lit(2), F.col("level"))
    ends = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)))
    touches = lambda c, part: (F.col(c) + reach >= F.col(part) * edge) & (F.col(c) - reach <= (F.col(part) + 1) * edge)
    places = grid.select(*(F.col(a).alias(f"g{a}") for a in POINT), *(F.col(f"{a}_km").alias(f"g{a}") for a in "xyz"))
    dealt = places.withColumn("tx", ends("gx")).withColumn("ty", ends("gy")).join(parts, ["tx", "ty"]).where(touches("gx", "part_x") & touches("gy", "part_y")).drop("tx", "ty")
    t = truth.select(*(F.col(a).alias(f"g{a}") for a in POINT), *(F.col(x).alias(f"t_{x}") for x in VARIABLES), physics.h().alias("t_ref"), F.lit(True).alias("counts"))
    known = steps.by_member(prior).join(t, ["gi", "gj", "gk"], "left").withColumn("counts", F.coalesce("counts", F.lit(False)))
    points = known.join(dealt, ["gi", "gj", "gk"])
    fine = 1 << multi_obs.DEPTH
    width = F.pow(F.lit(2), F.lit(multi_obs.DEPTH) - F.col("level")).cast("long")
    seen = obs
    for a in "xy":
        seen = seen.withColumn(f"f{a}", F.floor(F.col(f"{a}_km") / (size / fine)).cast("long")).withColumn(f"t{a}", F.floor(F.col(f"f{a}") / fine))
    seen = seen.join(parts, ["tx", "ty"]).where((F.floor(F.col("fx") / width) == F.col("part_x")) & (F.floor(F.col("fy") / width) == F.col("part_y")))
    seen = seen.select(*OBS, "x_km", "y_km", "z_km", "r0", *(F.col(c).alias(f"o_{c}") for c in multi_obs.PART))
    types = dict(obs.dtypes)
    fields = ", ".join([f"obs_id {types['obs_id']}", "combo_id int", *(f"{c} {types[c]}" for c in OBS[1:]), *(f"{c} double" for c in OUT)])
    own = [f"o_{c}" for c in multi_obs.PART]
    return points.repartition(tasks, *multi_obs.PART).groupBy(*multi_obs.PART).cogroup(seen.repartition(tasks, *own).groupBy(*own)).applyInArrow(_kernel(few, most_steps, cutoff), fields)
