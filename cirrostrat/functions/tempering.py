"""Tempering schedules and adaptive observation errors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_STEPS = 20


def step_weight(ntemp: Column, alpha_s: Column, step: Column) -> Column:
    """Weight of a step (from 1) of a schedule with ntemp steps: exp(-(ntemp + 1) * alpha_s / step), normalised."""
    raw = lambda i: F.exp(-(ntemp + 1) * alpha_s / i)
    total = F.aggregate(F.sequence(F.lit(1), ntemp.cast("int")), F.lit(0.0), lambda s, i: s + raw(i))
    return F.when(ntemp <= 1, F.lit(1.0)).otherwise(raw(step) / total)


def solve_ntemp(ratio: Column, alpha_s: Column, most: int = MOST_STEPS) -> Column:
    """The fewest steps whose first weight is not above 1 / ratio; most if none is so small."""
    fits = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: step_weight(n, alpha_s, F.lit(1)) <= F.lit(1.0) / ratio + 1e-9)
    return F.when(ratio <= 1.0 + 1e-6, F.lit(1)).otherwise(F.coalesce(F.get(fits, F.lit(0)), F.lit(most)))


def adaptive_error(departure: Column, variance: Column, r0: Column) -> Column:
    """Observation-error variance raised to what departure and ensemble variance are consistent with."""
    return F.greatest(r0, departure * departure - variance)


def error_of_step(method: Column, step: int, ntemp: Column, alpha_s: Column, r0: Column, adaptive: Column, own_ntemp: Column) -> Column:
    """Error variance of a step of each method; null where the observation is not used in that step.

    adaptive: the adaptive error from the state at the step's start; own_ntemp: steps that the
    observation needs for the adaptive error of the prior."""
    first = F.lit(step == 1)
    weight = lambda n: step_weight(n, alpha_s, F.lit(step))
    return (
        F.when((method == "LETKF") & first, r0)
        .when((method == "TEnKF") & (F.lit(step) <= ntemp), r0 / weight(ntemp))
        .when((method == "AOEI") & first, adaptive)
        .when((method == "TAOEI") & (F.lit(step) <= ntemp), adaptive / weight(ntemp))
        .when((method == "ATEnKF") & (F.lit(step) <= own_ntemp), r0 / weight(own_ntemp))
    )
