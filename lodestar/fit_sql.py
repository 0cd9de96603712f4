"""The maximum-likelihood fit of Davidson's model in SQL, by another way than the operators take: plain multiplicative steps,
many of them, and the inverse of the information by Gauss-Jordan elimination."""

from __future__ import annotations

STEPS = 250


def _shares() -> str:
    """Exponentials of a pair p under parameters x, counted from 1; d is their sum."""
    return "exp(x[p.i + 1]) + exp(x[p.j + 1]) + exp(x[{n} + 1] + (x[p.i + 1] + x[p.j + 1]) / 2)"


def fit_sql(n: int) -> str:
    """Common tables from ``keyed`` (g, i, j, w_ij, w_ji, t_ij; 0 <= i < j < n): fit (g, i, theta, strength, tie, var,
    log_likelihood), cov (g, i, j, c) and between (g, i, j, delta, var) of all i <> j. Needs WITH RECURSIVE."""
    d = _shares().format(n=n)
    m = "(p.w + p.v + p.t)"
    tie = f"exp(x[{n} + 1] + (x[p.i + 1] + x[p.j + 1]) / 2)"
    share = f"""CASE WHEN k = {n} THEN {m} * {tie} / ({d}) WHEN p.i = k THEN {m} * (exp(x[p.i + 1]) + {tie} / 2) / ({d})
    WHEN p.j = k THEN {m} * (exp(x[p.j + 1]) + {tie} / 2) / ({d}) ELSE 0 END"""
    one, two, three = "(CASE WHEN {0} = i THEN 1 ELSE 0 END)", "(CASE WHEN {0} = j THEN 1 ELSE 0 END)", f"(CASE WHEN {{0}} = {n} THEN 1.0 WHEN {{0}} IN (i, j) THEN 0.5 ELSE 0.0 END)"
    mean = "(p1 * {0} + p2 * {1} + p3 * {2})"
    of = lambda r: (one.format(r), two.format(r), three.format(r))
    entry = " + ".join(f"{p} * {a} * {b}" for p, a, b in zip(("p1", "p2", "p3"), of("r"), of("s")))
    entry = f"({entry} - {mean.format(*of('r'))} * {mean.format(*of('s'))})"
    return f"""pairs_of AS (SELECT g, list({{'i': i, 'j': j, 'w': w_ij::DOUBLE, 'v': w_ji::DOUBLE, 't': t_ij::DOUBLE}} ORDER BY i, j) AS c
  FROM keyed GROUP BY g),
won AS (SELECT g, c, list_transform(range({n + 1}), lambda k: list_sum(list_transform(c, lambda p: CASE WHEN k = {n} THEN p.t
  WHEN p.i = k THEN p.w + p.t / 2 WHEN p.j = k THEN p.v + p.t / 2 ELSE 0 END))) AS won FROM pairs_of),
steps AS (
  SELECT g, 0 AS step, list_transform(range({n + 1}), lambda k: 0.0::DOUBLE) AS x FROM won
  UNION ALL
  SELECT s.g, s.step + 1, list_transform(range({n + 1}), lambda k: x[k + 1]
    + ln(greatest(won[k + 1], 1e-300::DOUBLE) / greatest(list_sum(list_transform(c, lambda p: {share})), 1e-300::DOUBLE))) FROM steps s JOIN won w ON s.g = w.g WHERE s.step < {STEPS}),
ended AS (SELECT g, list_transform(x, lambda v, k: CASE WHEN k = {n + 1} THEN v ELSE v - list_sum(x[1:{n}]) / {n} END) AS x
  FROM steps WHERE step = {STEPS}),
shares AS (
  SELECT g, i, j, w_ij, w_ji, t_ij, a, b, z, a / (a + b + z) AS p1, b / (a + b + z) AS p2, z / (a + b + z) AS p3 FROM (
    SELECT c.*, exp(x[i + 1]) AS a, exp(x[j + 1]) AS b, exp(x[{n + 1}] + (x[i + 1] + x[j + 1]) / 2) AS z
    FROM keyed c JOIN ended e ON c.g = e.g)),
info AS (
  SELECT g, r, s, sum((w_ij + w_ji + t_ij) * {entry}) + CASE WHEN r < {n} AND s < {n} THEN 1.0::DOUBLE / {n} ELSE 0 END AS v
  FROM shares CROSS JOIN range({n + 1}) q(r) CROSS JOIN range({n + 1}) u(s) GROUP BY g, r, s),
matrix AS (SELECT g, list(line ORDER BY r) AS m FROM (SELECT g, r, list(v ORDER BY s) AS line FROM info GROUP BY g, r) GROUP BY g),
inverse AS (
  SELECT g, 1 AS k, m FROM matrix
  UNION ALL
  SELECT g, k + 1, list_transform(m, lambda line, r: list_transform(line, lambda v, s: CASE
    WHEN r = k AND s = k THEN 1 / v WHEN r = k THEN v / m[k][k] WHEN s = k THEN -v / m[k][k]
    ELSE v - line[k] * m[k][s] / m[k][k] END)) FROM inverse WHERE k <= {n + 1}),
cov AS (
  SELECT g, q.r::INT AS i, u.s::INT AS j, m[q.r + 1][u.s + 1] - 1.0::DOUBLE / {n} AS c
  FROM inverse CROSS JOIN range({n}) q(r) CROSS JOIN range({n}) u(s) WHERE k = {n + 2}),
value AS (SELECT g, sum(w_ij * ln(p1) + w_ji * ln(p2) + t_ij * ln(p3)) AS log_likelihood FROM shares GROUP BY g),
fit AS (
  SELECT e.g, c.i, x[c.i + 1] AS theta, exp(x[c.i + 1]) / list_sum(list_transform(x[1:{n}], lambda v: exp(v))) AS strength,
    exp(x[{n + 1}]) AS tie, c AS var, log_likelihood
  FROM ended e JOIN cov c ON e.g = c.g AND c.i = c.j JOIN value v ON e.g = v.g),
between_them AS (
  SELECT a.g, a.i, b.i AS j, a.theta - b.theta AS delta, a.var + b.var - 2 * c.c AS var FROM fit a
    JOIN fit b ON a.g = b.g AND a.i <> b.i JOIN cov c ON c.g = a.g AND c.i = a.i AND c.j = b.i)"""
