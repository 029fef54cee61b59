"""The jobs as queries: each runs twice into a folder of its own and returns all of its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cirrostrat.folders import new_folder
from cirrostrat.plans import catalog
from cirrostrat.plans import oracle as o
from cirrostrat.schema import VARIABLES

from . import departure_monitor, sweep_report


def job1_sweep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job1")
    sweep_report.run(spark, sf_dir, out)
    return catalog.rounded(sweep_report.run(spark, sf_dir, out))


def job2_departure_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job2")
    departure_monitor.run(spark, sf_dir, out)
    return catalog.rounded(departure_monitor.run(spark, sf_dir, out))


#: The combinations of sweep_report.json.
_ROWS = [("LETKF", 1, 1.0, 1.0, 1.0, 1.0), ("TEnKF", 1, 1.0, 1.0, 1.0, 1.0), ("TEnKF", 2, 1.0, 1.0, 1.0, 1.0), ("AOEI", 1, 1.0, 1.0, 1.0, 1.0)]


def _sql_sweep() -> str:
    def one(x: str) -> str:
        out = []
        for t in "fa":
            e, s = f"(m{t}_{x} - t_{x})", f"s{t}_{x}"
            out += [f"sqrt(avg({e} * {e})) AS rmse_{t}", f"avg({s}) AS spread_{t}", f"sqrt(sum(rho * {e} * {e}) / sum(rho)) AS rmse_{t}_w", f"any_value(yo) - max(CASE WHEN at_obs THEN m{t}_ref END) AS {'dep_b' if t == 'f' else 'dep_a'}"]
        return f"SELECT obs_id, combo_id, any_value(method) AS method, any_value(ntemp) AS ntemp, '{x}' AS var, {', '.join(out)} FROM cells GROUP BY obs_id, combo_id"

    base = f"{o.DOMAIN}, {o.SPLIT}, {o.obs(2)}, {o.combos(_ROWS)}, {o.PAIRS}, {o.ROWS}, {o.steps(2)}, {o.cells('a2')}"
    means = ", ".join(f"avg({c}) AS {c}" for c in sweep_report.MEASURES)
    each = " UNION ALL ".join(one(x) for x in (*VARIABLES, "ref"))
    shown = catalog._r("alpha_s", "lx", "ly", "lz", *sweep_report.MEASURES, "dep_b", "dep_a", "100 * (rmse_a - base) / nullif(base, 0) AS change")
    return f"""WITH {base}, metrics AS ({each}),
means AS (SELECT var, method, ntemp, 1e0 AS alpha_s, 1e0 AS lx, 1e0 AS ly, 1e0 AS lz, count(*) AS n_obs, {means}, sqrt(avg(dep_b * dep_b)) AS dep_b, sqrt(avg(dep_a * dep_a)) AS dep_a FROM metrics GROUP BY var, method, ntemp),
first AS (SELECT var, rmse_a AS base FROM means WHERE method = 'LETKF')
SELECT var, method, CAST(ntemp AS INT) AS ntemp, n_obs, {shown}, CAST(row_number() OVER (PARTITION BY var ORDER BY round(rmse_a, 6), method, ntemp) AS INT) AS place FROM means LEFT JOIN first USING (var)"""


def _sql_monitor() -> str:
    return f"""WITH d AS (
  SELECT 'events' AS feed, strftime(ts, '%Y-%m-%d') AS period, coalesce(event_type, '-') AS station, (value - 50e0) * 0.4e0 AS d FROM events
  UNION ALL SELECT 'texts', 'all', coalesce(lang, '-') || '/' || coalesce(source, '-'), (len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) - 250) * 0.02e0 FROM documents),
s AS (SELECT feed, coalesce(period, '-') AS period, station, count(d) AS n, avg(d) AS mean, sqrt(greatest(avg(d * d) - avg(d) * avg(d), 0)) AS std, min(d) AS least, max(d) AS most, count(*) FILTER (WHERE abs(d) > 10) AS n_large, count(*) FILTER (WHERE abs(d) > 10) / count(d) AS large_share FROM d WHERE d IS NOT NULL GROUP BY 1, 2, 3),
h AS (SELECT feed, coalesce(period, '-') AS period, station, least(CAST(floor(d + 20e0) AS INT), 39) AS bin, count(*) AS n_bin FROM d WHERE d BETWEEN -20 AND 20 GROUP BY 1, 2, 3, 4)
SELECT feed, period, station, n, {catalog._r("mean", "std", "least", "most", "large_share")}, n_large, bin, n_bin FROM s LEFT JOIN h USING (feed, period, station)"""


QUERIES = {"job1_sweep_report": job1_sweep_report, "job2_departure_monitor": job2_departure_monitor}
ORACLE_SQL = {"job1_sweep_report": _sql_sweep(), "job2_departure_monitor": _sql_monitor()}
