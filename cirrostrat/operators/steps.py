"""Analyses with one observation and any number of steps, as one plan.

What a step does to a grid point depends on that point's members and on the
ensemble of the observed quantity at the observation, and the latter depends on
the observation's own point alone. So the observation's point goes through all
its steps first: a row for each observation and combination, with its members
as arrays, gives the observed ensemble before each step and the step's error.
Every grid point of the zone then repeats these steps by itself. No group of a
zone is gathered: a row is a grid point with its members, whatever the zone's
size, and the plan is as deep for 20 steps as for one.

The formulas are those of ``single_obs``; rows are worked on in numpy, a batch
at a time. Errors and numbers of steps that depend on the ensemble are those of
the observation's own members, the same at every point. A member that a point
has and the observation lacks becomes null there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics, tempering
from ..schema import POINT, REFLECTIVITY_INPUTS, VARIABLES
from .single_obs import KEYS

#: Values (grid points x members x variables) that are worked on at once.
BLOCK = 1 << 19


def by_member(prior: DataFrame) -> DataFrame:
    """A row for each grid point: gi, gj, gk, ms (members in order) and an array for each variable."""
    each = F.array_sort(F.collect_list(F.struct("m", *VARIABLES)))
    rows = prior.groupBy(*(F.col(a).alias(f"g{a}") for a in POINT)).agg(each.alias("e"))
    return rows.select("gi", "gj", "gk", F.col("e.m").alias("ms"), *(F.col(f"e.{x}").alias(x) for x in VARIABLES))


def schedule(method: Column, ntemp: Column, alpha_s: Column, own_ntemp: Column) -> Column:
    """Weights of all steps of a method as an array."""
    steps = F.when(method.isin("TEnKF", "TAOEI"), ntemp).when(method == "ATEnKF", own_ntemp).otherwise(F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(1), steps), lambda s: tempering.step_weight(steps, alpha_s, s))


def _dense(column: pa.Array, members: np.ndarray, width: int) -> np.ndarray:
    """An array column as [rows, width], nan where a row has no value; members: the place of each value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.full((len(column), width), np.nan)
    out[np.repeat(np.arange(len(column)), lengths), members] = values
    return out


def _places(column: pa.Array, known: np.ndarray) -> np.ndarray:
    return np.searchsorted(known, (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False))


def _ragged(values: np.ndarray, has: np.ndarray) -> pa.Array:
    """[rows, width] as an array column of what is there; nan becomes null."""
    offsets = np.concatenate(([0], np.cumsum(has.sum(axis=1)))).astype(np.int32)
    flat = values[has]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=np.isnan(flat)))


def update(x: np.ndarray, has: np.ndarray, y: np.ndarray, yo: np.ndarray, r: np.ndarray, d2: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step. x [rows, members, variables] with the members that each row has; y [rows, members], nan where a member
    has none. Returns x, and the mean and variance of y that each row sees."""
    both = has & ~np.isnan(y)
    n = both.sum(axis=1)
    z = np.where(both, y, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = z.sum(axis=1) / n
        dy = np.where(both, y - mean[:, None], 0.0)
        var = np.where(n > 1, (dy * dy).sum(axis=1) / (n - 1), np.nan)
        lives = both[:, :, None] & ~np.isnan(x)
        dx = np.where(lives, x, 0.0)
        dx = np.where(lives, x - (dx.sum(axis=1) / lives.sum(axis=1))[:, None, :], 0.0)
        cov = np.einsum("rmv,rm->rv", dx, dy) / (n - 1)[:, None]
        local = r / np.maximum(np.exp(-0.5 * d2), 1e-6)
        factor = (y - mean[:, None]) / var[:, None] * (np.sqrt(local / (local + var)) - 1.0)[:, None] + ((yo - mean) / (local + var))[:, None]
        new = x + cov[:, None, :] * factor[:, :, None]
    go = active & (var > 0)
    return np.where(go[:, None, None], new, x), mean, var


def _stack(batch: pa.RecordBatch, prefix: str, members: np.ndarray, width: int) -> np.ndarray:
    return np.stack([_dense(batch.column(f"{prefix}{v}"), members, width) for v in VARIABLES], axis=2)


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, BLOCK // max(1, width * len(VARIABLES)))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def _history(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The observed ensemble before each step (one step after the other in ``ys``) and the error of each step."""
    for whole in batches:
        known = np.unique(whole.column("ms").flatten().to_numpy(zero_copy_only=False)) if whole.num_rows else np.zeros(0, int)
        for b in _slices(whole, len(known)):
            at = _places(b.column("ms"), known)
            x = _stack(b, "", at, len(known))
            has = ~np.isnan(_dense(b.column("ms"), at, len(known)))
            weights = [w.as_py() for w in b.column("weights")]
            count = np.array([len(w) for w in weights])
            yo, r0 = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("yo", "r0"))
            adaptive = np.array(b.column("adaptive").to_pylist(), bool)
            updated = np.array(b.column("updated").to_pylist(), bool)
            seen, errors = [], np.full((len(yo), int(count.max(initial=0))), np.nan)
            for s in range(errors.shape[1]):
                y = np.where(has, physics.reflectivity_of(*(x[:, :, VARIABLES.index(v)] for v in REFLECTIVITY_INPUTS)), np.nan)
                seen.append(y)
                on = count > s
                _, mean, var = update(x, has, y, yo, r0, np.zeros(len(yo)), np.zeros(len(yo), bool))
                raised = np.fmax(r0, (yo - mean) ** 2 - var)
                share = np.array([w[s] if len(w) > s else np.nan for w in weights])
                errors[:, s] = np.where(on, np.where(adaptive, raised, r0) / share, np.nan)
                x, _, _ = update(x, has, y, yo, errors[:, s], np.zeros(len(yo)), on & updated)
            steps = np.arange(errors.shape[1])[None, :] < count[:, None]
            ys = np.stack(seen, axis=1) if seen else np.zeros((len(yo), 0, len(known)))
            flat = (steps[:, :, None] & has[:, None, :]).reshape(len(yo), -1)
            yield pa.RecordBatch.from_arrays([b.column("obs_id"), b.column("combo_id"), b.column("own_ntemp"), b.column("ms"), _ragged(ys.reshape(len(yo), -1), flat), _ragged(errors, steps)], ["obs_id", "combo_id", "own_ntemp", "mo", "ys", "errors"])


def _replay(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Grid points with their members after all steps of their observation."""
    for whole in batches:
        if not whole.num_rows:
            continue
        known = np.unique(np.concatenate([whole.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ms", "mo")]))
        for b in _slices(whole, len(known)):
            at = _places(b.column("ms"), known)
            x = _stack(b, "", at, len(known))
            has = ~np.isnan(_dense(b.column("ms"), at, len(known)))
            yo, d2 = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("yo", "d2"))
            updated = np.array(b.column("updated").to_pylist(), bool)
            errors = b.column("errors")
            count = np.diff(errors.offsets.to_numpy())
            r = _dense(errors, np.concatenate([np.arange(n) for n in count]) if len(count) else np.zeros(0, int), int(count.max(initial=0)))
            observers = np.diff(b.column("mo").offsets.to_numpy())
            place = np.split(_places(b.column("mo"), known), np.cumsum(observers)[:-1])
            values = np.split(b.column("ys").flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(count * observers)[:-1])
            for s in range(r.shape[1]):
                y = np.full(has.shape, np.nan)
                for n in np.flatnonzero(count > s):
                    y[n, place[n]] = values[n][s * observers[n] : (s + 1) * observers[n]]
                x, _, _ = update(x, has, y, yo, r[:, s], d2, updated & (count > s))
            first = pa.array(r[:, 0] if r.shape[1] else np.full(len(yo), np.nan), mask=np.isnan(r[:, 0]) if r.shape[1] else np.ones(len(yo), bool))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), first, *(_ragged(x[:, :, n], has) for n in range(len(VARIABLES)))], [*kept, "err_1", *(f"a_{v}" for v in VARIABLES)])


def analyse(pairs: DataFrame, prior: DataFrame) -> DataFrame:
    """Rows as ``single_obs.analyse`` gives them for the prior's members at pairs, after all steps that each method and
    observation needs: pairs' columns, m, the variables, f_ and a variable's name (the prior), at_obs, own_ntemp and
    err_1 (the first step's error)."""
    points = by_member(prior)
    at_obs = (F.col("gi") == F.col("i")) & (F.col("gj") == F.col("j")) & (F.col("gk") == F.col("k"))
    own = pairs.where(at_obs).join(points, ["gi", "gj", "gk"])
    y = F.transform(F.arrays_zip(*REFLECTIVITY_INPUTS), lambda e: physics.reflectivity(*(e[x] for x in REFLECTIVITY_INPUTS)))
    own = own.withColumn("y", y).withColumn("y_mean", F.aggregate("y", F.lit(0.0), lambda s, v: s + v) / F.size("y"))
    own = own.withColumn("y_var", F.aggregate(F.transform("y", lambda v: (v - F.col("y_mean")) * (v - F.col("y_mean"))), F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size("y") - 1, F.lit(0)))
    raised = tempering.adaptive_error(F.col("yo") - F.col("y_mean"), F.col("y_var"), F.col("r0"))
    own = own.withColumn("own_ntemp", tempering.solve_ntemp(raised / F.greatest("r0", F.lit(1e-30)), F.col("alpha_s")).cast("int"))
    own = own.withColumns({"weights": schedule(F.col("method"), F.col("ntemp"), F.col("alpha_s"), F.col("own_ntemp")), "adaptive": F.col("method").isin("AOEI", "TAOEI")})
    columns = [*KEYS, "own_ntemp", "yo", "r0", "updated", "adaptive", "weights", "ms", *VARIABLES]
    types = dict(pairs.dtypes)
    history = own.select(*columns).mapInArrow(_history, f"obs_id {types['obs_id']}, combo_id {types['combo_id']}, own_ntemp int, mo array<int>, ys array<double>, errors array<double>")
    rows = pairs.withColumn("at_obs", at_obs).join(history, list(KEYS)).join(points, ["gi", "gj", "gk"])
    kept = [*pairs.columns, "at_obs", "own_ntemp", "ms", *VARIABLES]
    known = dict(rows.dtypes)
    fields = ", ".join([*(f"`{c}` {known[c]}" for c in kept), "err_1 double", *(f"a_{v} array<double>" for v in VARIABLES)])
    done = rows.select(*kept, "mo", "ys", "errors").mapInArrow(lambda it: _replay(it, kept), fields)
    each = F.explode(F.arrays_zip(F.col("ms").alias("m"), *(F.col(v).alias(f"f_{v}") for v in VARIABLES), *(F.col(f"a_{v}").alias(v) for v in VARIABLES)))
    meta = [*pairs.columns, "at_obs", "own_ntemp", "err_1"]
    return done.select(*meta, each.alias("e")).select(*meta, "e.*")
