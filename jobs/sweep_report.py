"""Which analysis is best: a sweep of methods and parameters over all observations of an ensemble, and its report.

    python -m jobs.sweep_report --tables FOLDER --out FOLDER [--config FILE] [--only METHOD] [--verbose 0-3]

One member is the truth, the others are the prior. Every observation that passes
quality control is an analysis of its own, for every combination of method and
parameters; errors and spreads over its localisation zone are its metrics.

Under ``--out``:

    metrics/method=/ntemp=   a row for each observation, combination and variable
    report/var=              for each variable and combination: means over observations, the change of the error
                             against the baseline in percent, and the combination's place

Both are written by dynamic partition overwrite, so a run that is repeated
replaces its own rows with the same ones. With ``--only`` one method is
analysed anew and the report is made of all metrics that are there: a stopped
sweep goes on method by method. Errors that are equal
to six decimals have places in order of method and steps. Absent members don't enter; without observations there are no rows.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cirrostrat.functions import stats
from cirrostrat.log import say, set_verbosity
from cirrostrat.operators import combos, ensemble, single_obs, verification
from cirrostrat.plans import fixtures, runner

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "sweep_report.json")
#: What is averaged over observations.
MEASURES = ("rmse_f", "rmse_a", "spread_f", "spread_a", "rmse_f_w", "rmse_a_w")


def load(path: str = CONFIG) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def analyse(state: DataFrame, grid: DataFrame, config: dict, only: str | None = None) -> DataFrame:
    """Metrics of all observations and combinations, or of those of one method."""
    truth = ensemble.truth_of(state, config["truth"])
    prior = ensemble.prior_of(state, config["truth"], config.get("prior_size"))
    obs = ensemble.observations(truth, prior, grid, stride=config.get("stride", 1), r0=config.get("obs_error_var", 5.0), **config.get("qc", {}))
    rows = combos.combinations(config["sweep"])
    table = combos.combo_table(state.sparkSession, config["sweep"])
    if only:
        rows, table = [r for r in rows if r[0] == only], table.where(F.col("method") == only)
    say(1, "%d combinations", len(rows))
    return single_obs.sweep(obs, table, grid, prior, truth, steps=runner.steps_of(rows)).drop("i", "j", "k")


def summarise(metrics: DataFrame, baseline: str) -> DataFrame:
    """The report: a row for each variable and combination."""
    by = ("var", "method", "ntemp", "alpha_s", "lx", "ly", "lz")
    means = metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n_obs"), *(F.avg(c).alias(c) for c in MEASURES), stats.rmse(F.col("dep_b")).alias("dep_b"), stats.rmse(F.col("dep_a")).alias("dep_a"))
    # The baseline's first combination stands for it; its error is set against all others'. Windows, as joins of the means would read the metrics again.
    first = F.min(F.when(F.col("method") == baseline, F.struct(*by[2:], "rmse_a"))).over(Window.partitionBy("var"))
    out = means.withColumn("change", verification.change(F.col("rmse_a"), first["rmse_a"]))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("var").orderBy(F.round("rmse_a", 6), *by[1:])))


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None, *, only: str | None = None) -> DataFrame:
    """Analyses, writes metrics and report, and returns the report."""
    config = config or load()
    state, grid = fixtures.domain(spark, tables)
    say(1, "read %s/orders.parquet: %d grid points", tables, grid.count())
    metrics = analyse(state, grid, config, only)
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "ntemp").parquet(f"{out}/metrics")
    stored = spark.read.schema(metrics.schema).parquet(f"{out}/metrics")
    say(1, "%d rows of metrics in %s/metrics", stored.count(), out)
    report = summarise(stored, config["baseline"])
    report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("var").parquet(f"{out}/report")
    say(1, "report in %s/report", out)
    return spark.read.schema(report.schema).parquet(f"{out}/report")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--tables", required=True, help="folder of the tables")
    parser.add_argument("--out", required=True, help="folder of metrics and report")
    parser.add_argument("--config", default=CONFIG, help="a JSON file")
    parser.add_argument("--only", help="one method of the configuration")
    parser.add_argument("--verbose", type=int, default=1)
    args = parser.parse_args(argv)
    set_verbosity(args.verbose)
    spark = SparkSession.builder.appName("sweep-report").getOrCreate()
    try:
        run(spark, args.tables.rstrip("/"), args.out.rstrip("/"), load(args.config), only=args.only).orderBy("var", "place").show(200, truncate=False)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
