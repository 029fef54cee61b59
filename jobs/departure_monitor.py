"""Monitoring of observation feeds: departures of what is observed from what is expected, as new files come in.

    python -m jobs.departure_monitor --tables FOLDER --out FOLDER [--config FILE] [--verbose 0-3]

A feed is a table that grows by files. Each run reads only the files that no
run has read (a file stream with a checkpoint for each feed), sums the
departures by station, period and bin, and merges the sums into the report.

Feeds are named in the configuration: ``name``, ``table`` and SQL expressions
for ``station``, ``period`` and ``departure``. One of the standard ones is of
values, by type and day; the other is of texts, whose departure is their number
of words from what is usual, by language and source.

Under ``--out``:

    checkpoint/<feed>            which files have been read
    sums/feed=/batch=            sums of each batch; a batch that is run again replaces its own
    statistics/feed=/period=     for each station: count, mean, spread, range, large departures
    histogram/feed=/period=      for each station and bin: count

Only periods with new sums are written anew, each from all its sums, by dynamic
partition overwrite. Each period of the report remembers the last batch in it,
so a run that stopped on its way to the report is made up by the next. A run without new files
changes nothing. Null and not-a-number departures don't count; a null station
or period is '-'; an empty feed has no rows.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.log import say, set_verbosity
from cirrostrat.streaming import departures

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "departure_monitor.json")
KEYS = ("period", "station")
SUMS = "period string, station string, bin int, n long, s double, s2 double, least double, most double, n_large long, feed string, batch long"


def load(path: str = CONFIG) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the job, empty where nothing has been written yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take_new(spark: SparkSession, feed: dict, tables: str, out: str, config: dict) -> None:
    """Sums of the feed's files that no run has read."""
    name = feed["name"]
    schema = spark.read.parquet(f"{tables}/{feed['table']}.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(config.get("files_per_batch", 64)))
    rows = stream.parquet(f"{tables}/{feed['table']}.parque[t]")  # a pattern, as a table may be a single file
    text = lambda e: F.coalesce(F.expr(e).cast("string"), F.lit("-"))
    rows = rows.select(text(feed["period"]).alias("period"), text(feed["station"]).alias("station"), F.expr(feed["departure"]).cast("double").alias("departure"))

    def add(batch: DataFrame, number: int) -> None:
        sums = departures.summed(batch, F.col("departure"), *KEYS, low=config["low"], high=config["high"], bins=config["bins"], large=config["large"])
        _replace(sums.withColumns({"feed": F.lit(name), "batch": F.lit(number).cast("long")}), f"{out}/sums", "feed", "batch")

    query = rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/checkpoint/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    for p in query.recentProgress:
        if p.numInputRows:
            say(1, "%s: batch %d read %d rows", name, p.batchId, p.numInputRows)


def report(spark: SparkSession, out: str) -> None:
    """Merges sums that the report doesn't have: their periods are written anew."""
    sums = _written(spark, f"{out}/sums", SUMS)
    have = "station string, n long, mean double, std double, least double, most double, n_large long, large_share double, last_batch long, feed string, period string"
    last = _written(spark, f"{out}/statistics", have).groupBy("feed", "period").agg(F.max("last_batch").alias("last"))
    newest = sums.groupBy("feed", "period").agg(F.max("batch").alias("last_batch"))
    periods = newest.join(last, ["feed", "period"], "left").where(F.col("last_batch") > F.coalesce("last", F.lit(-1))).drop("last")
    if not periods.limit(1).count():
        say(1, "nothing new")
        return
    keys = ("feed", *KEYS)
    merged = departures.merged(sums.join(periods, ["feed", "period"], "left_semi"), *keys)
    histogram = departures.histogram(merged, *keys)
    statistics = departures.statistics(merged, *keys).join(periods, ["feed", "period"])
    _replace(histogram, f"{out}/histogram", "feed", "period")
    _replace(statistics, f"{out}/statistics", "feed", "period")  # last: each period tells how far it is


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> DataFrame:
    """One run over what is new; returns the report as it stands: a row for each feed, period, station and bin
    (null where a station has no departure in any bin)."""
    config = config or load()
    for feed in config["feeds"]:
        take_new(spark, feed, tables, out, config)
    report(spark, out)
    return result(spark, out)


def result(spark: SparkSession, out: str) -> DataFrame:
    fields = "station string, n long, mean double, std double, least double, most double, n_large long, large_share double, feed string, period string"
    statistics = _written(spark, f"{out}/statistics", fields)
    histogram = _written(spark, f"{out}/histogram", "station string, bin int, n long, feed string, period string").withColumnRenamed("n", "n_bin")
    rows = statistics.join(histogram, ["feed", "period", "station"], "left")
    say(1, "report in %s", out)
    return rows.select("feed", "period", "station", "n", "mean", "std", "least", "most", "n_large", "large_share", "bin", "n_bin")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--tables", required=True, help="folder of the tables")
    parser.add_argument("--out", required=True, help="folder of checkpoint, sums and report")
    parser.add_argument("--config", default=CONFIG, help="a JSON file")
    parser.add_argument("--verbose", type=int, default=1)
    args = parser.parse_args(argv)
    set_verbosity(args.verbose)
    spark = SparkSession.builder.appName("departure-monitor").getOrCreate()
    try:
        rows = run(spark, args.tables.rstrip("/"), args.out.rstrip("/"), load(args.config))
        say(1, "%d rows in the report", rows.count())
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
