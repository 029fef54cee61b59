"""Invariants of schedules, adaptive errors and step counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat.functions import tempering


def schedule(spark, ntemp, alpha_s):
    rows = spark.range(1, ntemp + 1).select(F.col("id").alias("step"), tempering.step_weight(F.lit(ntemp), F.lit(float(alpha_s)), F.col("id")).alias("w"))
    return np.array([r.w for r in rows.orderBy("step").collect()])


@pytest.mark.parametrize("ntemp", [1, 2, 3, 5, 10])
def test_weights_sum_to_one(spark, ntemp):
    for alpha_s in (0.0, 0.5, 2.0, 5.0):
        assert schedule(spark, ntemp, alpha_s).sum() == pytest.approx(1.0, abs=1e-5)


def test_equal_increasing_and_single(spark):
    for n in (1, 3, 5, 10):
        assert schedule(spark, n, 0.0) == pytest.approx(np.full(n, 1 / n), abs=1e-5)
    assert (np.diff(schedule(spark, 5, 2.0)) > 0).all()
    assert schedule(spark, 1, 2.0).tolist() == [1.0]


def test_known_values(spark):
    assert schedule(spark, 3, 2.0) == pytest.approx([0.00380626, 0.20781451, 0.78837925], abs=1e-7)
    assert schedule(spark, 2, 2.0) == pytest.approx([0.04742587, 0.95257413], abs=1e-7)


def test_adaptive_error(spark):
    rng = np.random.default_rng(0)
    rows = []
    for case in range(100):
        for o in range(int(rng.integers(1, 10))):
            y = rng.normal(size=15) * 3
            rows += [(case * 10 + o, float(abs(rng.normal()) * 10 + 1), float(rng.normal() * 5), float(v)) for v in y]
    df = spark.createDataFrame(rows, "id int, r0 double, yo double, y double").groupBy("id").agg(F.max("r0").alias("r0"), F.max("yo").alias("yo"), F.avg("y").alias("m"), F.var_samp("y").alias("v"))
    out = df.select("r0", tempering.adaptive_error(F.col("yo") - F.col("m"), F.col("v"), F.col("r0")).alias("r")).collect()
    assert all(x.r >= x.r0 - 1e-6 for x in out)

    def one(yo, values):
        v = F.lit(float(np.var(values, ddof=1)))
        return spark.range(1).select(tempering.adaptive_error(F.lit(yo - float(np.mean(values))), v, F.lit(25.0))).first()[0]

    assert one(10.0, np.random.default_rng(1).normal(9.5, 1.5, 20)) == 25.0
    assert one(50.0, np.random.default_rng(2).normal(10, 1, 20)) > 25.0


def steps(spark, ratios, alpha_s=1.0, most=20):
    df = spark.createDataFrame([(n, float(r)) for n, r in enumerate(ratios)], "n int, r double")
    return [x.s for x in df.select("n", tempering.solve_ntemp(F.col("r"), F.lit(alpha_s), most).alias("s")).orderBy("n").collect()]


def test_step_counts(spark):
    assert steps(spark, [0.5, 1.0]) == [1, 1]
    assert steps(spark, [1, 2, 5, 8, 10, 50, 100]) == [1, 2, 2, 3, 3, 4, 5]
    for most in (5, 10, 20):
        assert steps(spark, [1e30], most=most)[0] <= most


def test_first_step_and_information(spark):
    n = steps(spark, [8.0])[0]
    assert 25.0 / schedule(spark, n, 1.0)[0] >= 200.0 - 1e-3
    for ntemp in (1, 2, 3, 5, 10, 20):
        assert (schedule(spark, ntemp, 1.0) / 25.0).sum() == pytest.approx(1 / 25.0, abs=1e-5)
