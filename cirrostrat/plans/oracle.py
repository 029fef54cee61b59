"""The same queries as SQL for an independent engine: building blocks."""

from __future__ import annotations

from ..functions import physics as ph
from ..schema import VARIABLES

STATE = """state AS (
  SELECT CAST(l_partkey % 4 AS INT) AS i, CAST((l_orderkey // 7) % 4 AS INT) AS j, CAST(l_linenumber % 3 AS INT) AS k, CAST(l_orderkey % 8 AS INT) AS m,
    abs(avg(l_tax) - 0.04e0) * 0.2e0 AS qg, abs(avg(l_discount) - 0.05e0) * 0.2e0 AS qr,
    abs(avg(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END) - 0.25e0) * 0.01e0 AS qs,
    273e0 + 2e0 * (avg(l_quantity) - 25.5e0) AS t, 50000e0 + avg(l_extendedprice) / 2e0 AS p,
    avg(l_quantity) - 25.5e0 AS u, avg(l_extendedprice) / 1000e0 - 38e0 AS v, (avg(l_discount) - 0.05e0) * 100e0 AS w
  FROM lineitem GROUP BY 1, 2, 3, 4)"""
GRID = """grid AS (
  SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, 2e0 * i AS x_km, 2e0 * j AS y_km, 1e0 * k AS z_km
  FROM range(4) a(i), range(4) b(j), range(3) c(k))"""
DOMAIN = """side AS (SELECT CAST(greatest(1, floor(sqrt(count(*) // 24))) AS BIGINT) AS side FROM orders),
orders_at AS (SELECT CAST((o_orderkey // 24) % side AS INT) AS i, CAST((o_orderkey // 24) // side AS INT) AS j, CAST((o_orderkey // 8) % 3 AS INT) AS k, CAST(o_orderkey % 8 AS INT) AS m,
  CAST(round(o_totalprice * 100e0) AS BIGINT) % 997 AS a, (CAST(round(o_totalprice * 100e0) AS BIGINT) // 997) % 991 AS b, o_custkey % 89 AS c, side FROM orders, side),
state AS (SELECT i, j, k, m, b / 991e0 * 0.002e0 AS qg, a / 997e0 * 0.002e0 AS qr, c / 89e0 * 0.001e0 AS qs, (a - b) / 100e0 + 273e0 AS t, b * 30e0 + 60000e0 AS p,
  (b - 495) / 30e0 AS u, (a - 498) / 30e0 AS v, (c - 44) / 20e0 AS w FROM orders_at WHERE j < side),
grid AS (SELECT DISTINCT i, j, k, 2e0 * i AS x_km, 2e0 * j AS y_km, 1e0 * k AS z_km FROM state)"""
SPLIT = "truth AS (SELECT * FROM state WHERE m = 3), prior AS (SELECT * FROM state WHERE m <> 3 AND m < 7)"


def h(f: str = "") -> str:
    """Reflectivity of columns with that prefix."""
    ro = f"({f}p / ({ph.RD!r} * {f}t))"
    rain = f"CASE WHEN {f}qr > 0 THEN {ph.RAIN!r}::DOUBLE * pow({ro} * {f}qr, 1.75e0) ELSE 0e0 END"
    snow = f"CASE WHEN {f}qs > 0 THEN (CASE WHEN {f}t <= {ph.MELTING!r} THEN {ph.DRY_SNOW!r}::DOUBLE ELSE {ph.WET_SNOW!r}::DOUBLE END) * pow({ro} * {f}qs, 1.75e0) ELSE 0e0 END"
    graupel = f"CASE WHEN {f}qg > 0 THEN {ph.GRAUPEL!r}::DOUBLE * pow({ro} * {f}qg, 1.6625e0) ELSE 0e0 END"
    total = f"({rain} + {snow} + {graupel})"
    return f"CASE WHEN {total} > 0 THEN greatest(10e0 * log10({total}), -20e0) ELSE -20e0 END"


def obs(stride: int = 1, test: str = "most >= 5") -> str:
    return f"""obs AS (
  SELECT CAST(tr.i AS BIGINT) * 68719476736 + CAST(tr.j AS BIGINT) * 4096 + tr.k AS obs_id, tr.i, tr.j, tr.k, x_km, y_km, z_km, tr.y AS yo, tr.y AS yo_clean, 5e0 AS r0
  FROM (SELECT *, {h()} AS y FROM truth) tr
  JOIN (SELECT i, j, k, max({h()}) AS most FROM prior GROUP BY i, j, k) USING (i, j, k) JOIN grid USING (i, j, k)
  WHERE tr.i % {stride} = 0 AND tr.j % {stride} = 0 AND ({test}))"""


def combos(rows: list[tuple]) -> str:
    values = ", ".join(f"({n}, '{m}', {nt}, {a!r}::DOUBLE, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for n, (m, nt, a, x, y, z) in enumerate(rows))
    return f"combos(combo_id, method, ntemp, alpha_s, lx, ly, lz) AS (VALUES {values})"


PAIRS = f"""pairs AS (
  SELECT *, CASE WHEN d2 <= {ph.SUPPORT2!r} THEN exp(-0.5e0 * d2) ELSE 0e0 END AS rho, d2 <= {ph.SUPPORT2**0.5!r}::DOUBLE * greatest(lx, ly, lz) AS updated
  FROM (SELECT o.*, c.*, g.i AS gi, g.j AS gj, g.k AS gk,
      pow((g.x_km - o.x_km) / lx, 2) + pow((g.y_km - o.y_km) / ly, 2) + pow((g.z_km - o.z_km) / lz, 2) AS d2
    FROM obs o, combos c, grid g)
  WHERE d2 <= {ph.SUPPORT2!r})"""
ROWS = f"""s0 AS (
  SELECT pairs.*, p.m, {", ".join(f"p.{x}, p.{x} AS f_{x}" for x in VARIABLES)}, gi = pairs.i AND gj = pairs.j AND gk = pairs.k AS at_obs,
    NULL::DOUBLE AS y, NULL::DOUBLE AS y_mean, NULL::DOUBLE AS y_var, 1 AS own_ntemp
  FROM pairs JOIN prior p ON p.i = gi AND p.j = gj AND p.k = gk)"""


def weight(ntemp: str, step: str) -> str:
    return f"(CASE WHEN {ntemp} <= 1 THEN 1e0 ELSE exp(-({ntemp} + 1) * alpha_s / {step}) / list_sum(list_transform(range(1, CAST({ntemp} AS BIGINT) + 1), lambda x: exp(-({ntemp} + 1) * alpha_s / x))) END)"


def steps(n: int) -> str:
    """The CTEs a1 .. an: rows after each step."""
    out = []
    for s in range(1, n + 1):
        before = "s0" if s == 1 else f"a{s - 1}"
        names = ", ".join(("y", "y_mean", "y_var", "own_ntemp", "r_step") if s > 1 else ("y", "y_mean", "y_var", "own_ntemp"))
        ratio = "greatest(r0, pow(yo - y_mean, 2) - y_var) / r0"
        own = f"CASE WHEN {ratio} <= 1.000001e0 THEN 1 ELSE coalesce(list_filter(range(1, 21), lambda n: {weight('n', '1')} <= 1 / ({ratio}) + 1e-9)[1], 20) END" if s == 1 else "own0"
        adaptive = "greatest(r0, pow(yo - y_mean, 2) - y_var)"
        error = f"""CASE WHEN method = 'LETKF' AND {s} = 1 THEN r0 WHEN method = 'TEnKF' AND {s} <= ntemp THEN r0 / {weight("ntemp", str(s))}
      WHEN method = 'AOEI' AND {s} = 1 THEN {adaptive} WHEN method = 'TAOEI' AND {s} <= ntemp THEN {adaptive} / {weight("ntemp", str(s))}
      WHEN method = 'ATEnKF' AND {s} <= own_ntemp THEN r0 / {weight("own_ntemp", str(s))} END"""
        local = "(r_step / greatest(exp(-0.5e0 * d2), 1e-6))"
        factor = f"((y - y_mean) / y_var * (sqrt({local} / ({local} + y_var)) - 1) + (yo - y_mean) / ({local} + y_var))"
        keep = f"* EXCLUDE ({names})" if s == 1 else f"* EXCLUDE ({names}), own_ntemp AS own0"
        cov = ", ".join(f"covar_samp({x}, y) OVER cell AS c_{x}" for x in VARIABLES)
        new = ", ".join(f"CASE WHEN updated AND r_step IS NOT NULL AND y_var > 0 THEN {x} + c_{x} * {factor} ELSE {x} END AS {x}" for x in VARIABLES)
        out.append(f"""y{s} AS (SELECT {keep}, max(CASE WHEN at_obs THEN {h()} END) OVER (PARTITION BY obs_id, combo_id, m) AS y FROM {before}),
v{s} AS (SELECT *, avg(y) OVER cell AS y_mean, var_samp(y) OVER cell AS y_var, {cov} FROM y{s} WINDOW cell AS (PARTITION BY obs_id, combo_id, gi, gj, gk)),
o{s} AS (SELECT *{" EXCLUDE (own0)" if s > 1 else ""}, {own} AS own_ntemp FROM v{s}),
e{s} AS (SELECT *, {error} AS r_step FROM o{s}),
a{s} AS (SELECT * EXCLUDE ({", ".join([*VARIABLES, *(f"c_{x}" for x in VARIABLES)])}), {new} FROM e{s})""")
    return ",\n".join(out)


def gain(error: str = "r0") -> str:
    """The CTE ``analysed``: mean and spread of every variable at every point after one step with all observations in
    reach, by Kalman's gain in observation space. Its linear systems are solved by elimination, a row at a time; they
    have a row for each observation in reach of a point. error: of an observation, in terms of yo, y_mean, y_var and r0.
    Needs state, grid, truth, prior, obs and combos (one)."""
    covariances = ", ".join(f"covar_samp(p.{x}, y.y) AS c_{x}" for x in VARIABLES)
    right = " UNION ALL ".join(["SELECT gi, gj, gk, a, 0 AS b, yo - y_mean AS v FROM numbered", *(f"SELECT gi, gj, gk, a, {-n} AS b, c_{x} AS v FROM across" for n, x in enumerate(VARIABLES, 1))])
    means = ", ".join(f"any_value(xm_{x}) + coalesce(sum(c_{x} * z) FILTER (WHERE b = 0), 0) AS {x}, sqrt(any_value(xv_{x}) - coalesce(sum(c_{x} * z) FILTER (WHERE b = {-n}), 0)) AS s_{x}" for n, x in enumerate(VARIABLES, 1))
    prior = ", ".join(f"avg({x}) AS xm_{x}, var_samp({x}) AS xv_{x}" for x in VARIABLES)
    return f"""y AS (SELECT obs_id, m, {h("p.")} AS y FROM prior p JOIN obs USING (i, j, k)),
seen AS (SELECT obs.*, y_mean, y_var FROM obs JOIN (SELECT obs_id, avg(y) AS y_mean, var_samp(y) AS y_var FROM y GROUP BY obs_id) USING (obs_id)),
numbered AS (
  SELECT *, {error} / greatest(exp(-0.5e0 * d2), 1e-6) AS r, row_number() OVER (PARTITION BY gi, gj, gk ORDER BY obs_id) AS a
  FROM (SELECT o.*, g.i AS gi, g.j AS gj, g.k AS gk, lx, ly, lz, pow((g.x_km - o.x_km) / lx, 2) + pow((g.y_km - o.y_km) / ly, 2) + pow((g.z_km - o.z_km) / lz, 2) AS d2 FROM seen o, combos c, grid g)
  WHERE d2 <= {ph.SUPPORT2**0.5!r}::DOUBLE * greatest(lx, ly, lz)),
across AS (SELECT gi, gj, gk, a, {covariances} FROM numbered n JOIN prior p ON p.i = gi AND p.j = gj AND p.k = gk JOIN y ON y.obs_id = n.obs_id AND y.m = p.m GROUP BY gi, gj, gk, a),
together AS (SELECT DISTINCT s.obs_id AS one, t.obs_id AS two FROM numbered s JOIN numbered t USING (gi, gj, gk)),
shared AS (SELECT one, two, covar_samp(s.y, t.y) AS c FROM together JOIN y s ON s.obs_id = one JOIN y t ON t.obs_id = two AND t.m = s.m GROUP BY one, two),
solved AS (
  SELECT 0 AS step, * FROM (SELECT s.gi, s.gj, s.gk, s.a, t.a AS b, c + CASE WHEN s.a = t.a THEN s.r ELSE 0e0 END AS v FROM numbered s JOIN numbered t USING (gi, gj, gk) JOIN shared ON one = s.obs_id AND two = t.obs_id UNION ALL {right})
  UNION ALL
  SELECT step + 1, gi, gj, gk, a, b, CASE WHEN a = step + 1 THEN v / diagonal ELSE v - own * across / diagonal END
  FROM (SELECT *, max(v) FILTER (WHERE a = step + 1 AND b = step + 1) OVER (PARTITION BY gi, gj, gk) AS diagonal, max(v) FILTER (WHERE b = step + 1) OVER (PARTITION BY gi, gj, gk, a) AS own,
      max(v) FILTER (WHERE a = step + 1) OVER (PARTITION BY gi, gj, gk, b) AS across, max(a) OVER (PARTITION BY gi, gj, gk) AS last FROM solved)
  WHERE step < last AND (b <= 0 OR b > step + 1)),
weights AS (SELECT gi, gj, gk, a, b, v AS z FROM (SELECT *, max(step) OVER (PARTITION BY gi, gj, gk) AS last FROM solved) WHERE step = last AND b <= 0),
analysed AS (
  SELECT i, j, k, {means}
  FROM (SELECT i, j, k, {prior} FROM prior GROUP BY i, j, k) LEFT JOIN (weights JOIN across USING (gi, gj, gk, a)) ON gi = i AND gj = j AND gk = k GROUP BY i, j, k)"""


def cells(last: str) -> str:
    own = ", ".join(f"avg(f_{x}) AS mf_{x}, avg({x}) AS ma_{x}, stddev_samp(f_{x}) AS sf_{x}, stddev_samp({x}) AS sa_{x}" for x in VARIABLES)
    t = ", ".join(f"{x} AS t_{x}" for x in VARIABLES)
    return f"""cells0 AS (SELECT obs_id, combo_id, gi, gj, gk, {own}, avg({h("f_")}) AS mf_ref, stddev_samp({h("f_")}) AS sf_ref, avg({h()}) AS ma_ref, stddev_samp({h()}) AS sa_ref,
    any_value(rho) AS rho, any_value(at_obs) AS at_obs, any_value(method) AS method, any_value(ntemp) AS ntemp, any_value(yo) AS yo
  FROM {last} GROUP BY obs_id, combo_id, gi, gj, gk),
cells AS (SELECT * FROM cells0 JOIN (SELECT i AS gi, j AS gj, k AS gk, {t}, {h()} AS t_ref FROM truth) USING (gi, gj, gk))"""


def unpivot(select: str, names: tuple[str, ...]) -> str:
    """One SELECT for each name, where {x} stands for it."""
    return " UNION ALL ".join(select.replace("{x}", x) for x in names)
