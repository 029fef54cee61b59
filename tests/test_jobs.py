"""Jobs: two runs over growing input, repeated runs, stopped runs, and odd rows."""

import datetime
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cirrostrat.operators import combos, ensemble, neighbours, verification
from cirrostrat.plans import catalog, fixtures
from cirrostrat.streaming import departures
from jobs import departure_monitor, sweep_report
from tests.test_zones import shuffled

SF = "/root/testdata/sf0.001"
FIELDS = ("feed", "period", "station", "n", "mean", "std", "least", "most", "n_large", "large_share", "bin", "n_bin")
EVENTS = "event_id long, ts timestamp, event_type string, value double"
TEXTS = "doc_id long, text string, lang string, source string"


def events(spark, first, last, day=1):
    ts = datetime.datetime(2024, 1, day)
    rows = [(i, ts + datetime.timedelta(minutes=i), None if i % 11 == 0 else f"t{i % 3}", None if i % 13 == 0 else float(i % 97)) for i in range(first, last)]
    return spark.createDataFrame([*rows, (None, None, None, float("nan"))], EVENTS)


def texts(spark, first, last):
    rows = [(i, None if i % 7 == 0 else "word " * (i % 50 * 20), "de" if i % 2 else None, "hot" if i % 3 else "cold") for i in range(first, last)]
    return spark.createDataFrame(rows, TEXTS)


def add(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def shown(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in FIELDS)) for r in df.collect()), key=repr)


def expected(spark, tables):
    """The report from all rows at once, by the batch operators."""
    config = departure_monitor.load()
    out = None
    for feed in config["feeds"]:
        rows = spark.read.parquet(f"{tables}/{feed['table']}.parquet")
        text = lambda e: F.coalesce(F.expr(e).cast("string"), F.lit("-"))
        d = rows.select(F.lit(feed["name"]).alias("feed"), text(feed["period"]).alias("period"), text(feed["station"]).alias("station"), F.expr(feed["departure"]).alias("d")).where("d is not null and not isnan(d)")
        keys = ("feed", "period", "station")
        total = verification.innovations(d, *keys).drop("median")
        bins = verification.histogram(d, F.col("d"), -20.0, 20.0, 40, *keys).withColumnRenamed("n", "n_bin")
        part = total.join(bins, list(keys), "left").select(*FIELDS)
        out = part if out is None else out.unionByName(part)
    return out


def test_monitor_over_growing_feeds(spark, tmp_path):
    tables, out = str(tmp_path / "tables"), str(tmp_path / "out")
    add(events(spark, 0, 500), f"{tables}/events.parquet")
    add(texts(spark, 0, 60), f"{tables}/documents.parquet")
    first = shown(departure_monitor.run(spark, tables, out))
    assert first == shown(expected(spark, tables))
    sums = spark.read.parquet(f"{out}/sums")
    assert shown(departure_monitor.run(spark, tables, out)) == first  # nothing new
    assert spark.read.parquet(f"{out}/sums").count() == sums.count()
    old = {f for f in os.listdir(f"{out}/statistics/feed=events/period=2024-01-01") if f.endswith(".parquet")}
    add(events(spark, 500, 900, day=3), f"{tables}/events.parquet")
    add(texts(spark, 60, 150), f"{tables}/documents.parquet")
    second = shown(departure_monitor.run(spark, tables, out))
    assert second == shown(expected(spark, tables)) != first
    # What was read before isn't read again, and periods without news keep their files.
    assert spark.read.parquet(f"{out}/sums").where("feed = 'events'").groupBy("batch").agg(F.sum("n").alias("n")).count() == 2
    assert {f for f in os.listdir(f"{out}/statistics/feed=events/period=2024-01-01") if f.endswith(".parquet")} == old


def test_monitor_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    tables, out = str(tmp_path / "tables"), str(tmp_path / "out")
    add(events(spark, 0, 300), f"{tables}/events.parquet")
    add(texts(spark, 0, 30), f"{tables}/documents.parquet")
    departure_monitor.run(spark, tables, out)
    add(events(spark, 300, 400), f"{tables}/events.parquet")
    with monkeypatch.context() as m:
        m.setattr(departure_monitor, "report", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            departure_monitor.run(spark, tables, out)
    assert shown(departure_monitor.run(spark, tables, out)) == shown(expected(spark, tables))


def test_monitor_repeats_a_batch(spark, tmp_path):
    """Sums of a batch that fails on its way are written again under the same number."""
    tables, out = str(tmp_path / "tables"), str(tmp_path / "out")
    add(events(spark, 0, 200), f"{tables}/events.parquet")
    config = departure_monitor.load()
    config["feeds"] = config["feeds"][:1]
    real = departure_monitor._replace
    calls = []

    def broken(rows, path, *by):
        real(rows, path, *by)
        calls.append(path)
        if len(calls) == 1:
            raise RuntimeError("lost")

    departure_monitor._replace = broken
    try:
        with pytest.raises(Exception, match="lost"):
            departure_monitor.run(spark, tables, out, config)
        departure_monitor.run(spark, tables, out, config)
    finally:
        departure_monitor._replace = real
    assert spark.read.parquet(f"{out}/sums").agg(F.sum("n")).first()[0] == expected_events(spark, tables)
    assert len([c for c in calls if c.endswith("sums")]) == 2


def expected_events(spark, tables):
    return spark.read.parquet(f"{tables}/events.parquet").where("value is not null and not isnan(value)").count()


def test_monitor_of_empty_feeds(spark, tmp_path):
    tables, out = str(tmp_path / "tables"), str(tmp_path / "out")
    spark.createDataFrame([], EVENTS).write.parquet(f"{tables}/events.parquet")
    spark.createDataFrame([], TEXTS).write.parquet(f"{tables}/documents.parquet")
    assert departure_monitor.run(spark, tables, out).count() == 0


def test_sums_of_parts_merge(spark):
    rows = spark.range(1000).selectExpr("id % 3 as g", "cast(id * 37 % 101 as double) - 50 as d", "id % 4 as part")
    whole = departures.statistics(departures.summed(rows, F.col("d"), "g"), "g")
    parts = departures.merged(departures.summed(rows, F.col("d"), "g", "part").drop("part"), "g")
    key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert key(departures.statistics(parts, "g")) == key(whole)
    assert key(departures.histogram(parts, "g")) == key(verification.histogram(rows, F.col("d"), -20.0, 20.0, 40, "g").select("g", "bin", "n"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_sweep_report_goes_on_method_by_method(spark, tmp_path):
    whole = sorted(catalog.rounded(sweep_report.run(spark, SF, str(tmp_path / "a"))).collect(), key=repr)
    out = str(tmp_path / "b")
    for method in ("AOEI", "LETKF", "TEnKF", "AOEI"):
        got = sweep_report.run(spark, SF, out, only=method)
    assert sorted(catalog.rounded(got).collect(), key=repr) == whole
    assert {r.method for r in whole} == {"AOEI", "LETKF", "TEnKF"} and {r.place for r in whole} == {1, 2, 3, 4}
    assert all(r.change == 0 for r in whole if r.method == "LETKF")
    assert sorted(os.listdir(f"{out}/metrics"))[-3:] == ["method=AOEI", "method=LETKF", "method=TEnKF"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_sweep_report_shuffles_no_zone(spark, tmp_path):
    """What is shuffled grows with the ensemble, not with every observation's zone, combination and member."""
    state, grid = fixtures.domain(spark, SF)
    prior = ensemble.prior_of(state, 3, 6)
    obs = ensemble.observations(ensemble.truth_of(state, 3), prior, grid, stride=2)
    zone = neighbours.localised_pairs(obs, combos.combo_table(spark, sweep_report.load()["sweep"]), grid).count() * 6
    assert 0 < shuffled(spark, lambda: sweep_report.run(spark, SF, str(tmp_path / "out"))) < zone / 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_sweep_report_reads_metrics_once(spark, tmp_path):
    """The report is made by one pass over the metrics, not by joins of their means with each other."""
    out = str(tmp_path / "out")
    sweep_report.run(spark, SF, out)
    metrics = spark.read.parquet(f"{out}/metrics")
    report = sweep_report.summarise(metrics, "LETKF")
    assert report._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == 1
    assert {r.change for r in report.where("method = 'LETKF'").collect()} == {0.0}


def test_command_lines(tmp_path):
    """The command line makes its own session and takes plain paths."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "c.json").write_text(json.dumps(departure_monitor.load() | {"feeds": departure_monitor.load()["feeds"][:1]}))
    done = subprocess.run([sys.executable, "-m", "jobs.departure_monitor", "--tables", SF, "--out", str(tmp_path / "out"), "--config", str(tmp_path / "c.json")], cwd=root, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "events: batch 0 read 1000 rows" in done.stderr and "rows in the report" in done.stderr
