"""SQL of the fitted models: every step of their iterations as a named step of the query (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Sequence

from regionlens.plans.oracle import _Z

EULER_GAMMA = 0.5772156649015329  # fixed value


def _steps(steps: dict[str, str], answer: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in steps.items()) + f"\n{answer}"


def kmeans_sql(features: str, cols: Sequence[str], k: int = 5, runs: int = 10, rounds: int = 25, unit: int = 1 << 24) -> str:
    """Seeds by farthest points, ``rounds`` rounds of moved centres, the cheapest run, clusters numbered by their first region.

    Enough rounds for the tables of the tests; a run that stands still stays the same in further ones.
    """
    xs = [f"x{i}" for i in range(len(cols))]
    z = [f"round(coalesce(({_Z.format(c=c)}), 0) * {unit}) / {unit}.0 AS {x}" for c, x in zip(cols, xs)]
    far = " + ".join(f"(p.{x} - c.{x}) * (p.{x} - c.{x})" for x in xs)
    names, ours = ", ".join(xs), ", ".join(f"p.{x}" for x in xs)
    steps = {
        "pts": f"SELECT state, {', '.join(z)} FROM {features}",
        "c0": f"SELECT row_number() OVER (ORDER BY {' + '.join(f'{x} * {x}' for x in xs)} DESC, state) - 1 AS r, 0 AS j, {names} FROM pts QUALIFY r < {runs}",
    }
    for j in range(1, k):
        steps[f"c{j}"] = f"""SELECT * FROM c{j - 1} UNION ALL SELECT r, {j} AS j, {names} FROM (
            SELECT c.r, p.state, {ours}, min({far}) AS near FROM pts AS p, c{j - 1} AS c GROUP BY c.r, p.state, {ours}
            QUALIFY row_number() OVER (PARTITION BY c.r ORDER BY near DESC, p.state) = 1)"""
    last = f"c{k - 1}"
    for t in range(rounds + 1):
        steps[f"a{t}"] = f"SELECT c.r, c.j, p.*, {far} AS d FROM pts AS p, {last} AS c QUALIFY row_number() OVER (PARTITION BY c.r, p.state ORDER BY {far}, c.j) = 1"
        means = ", ".join(f"coalesce(avg(p.{x}), c.{x}) AS {x}" for x in xs)
        steps[f"m{t}"] = f"SELECT c.r, c.j, {means} FROM {last} AS c LEFT JOIN a{t} AS p ON p.r = c.r AND p.j = c.j GROUP BY c.r, c.j, {', '.join(f'c.{x}' for x in xs)}"
        last = f"m{t}"
    steps["best"] = f"SELECT state, j FROM a{rounds} WHERE r = (SELECT r FROM a{rounds} GROUP BY r ORDER BY sum(d), r LIMIT 1)"
    return _steps(steps, """SELECT state, cluster, 'Cluster ' || (cluster + 1) AS cluster_label FROM (
        SELECT state, dense_rank() OVER (ORDER BY first) - 1 AS cluster FROM (SELECT state, min(state) OVER (PARTITION BY j) AS first FROM best))""")


def pca_sql(table: str, cols: Sequence[str], rounds: int = 300) -> str:
    """Power iteration for the first axis, again on what it leaves for the second."""
    d = len(cols)
    start = "[" + ", ".join(["1.0"] * d) + "]"
    loop = lambda m: f"""SELECT v FROM (WITH RECURSIVE p(n, v) AS (SELECT 0, CAST({start} AS DOUBLE[]) UNION ALL
        SELECT n + 1, list_transform(u, lambda e: e / sqrt(list_dot_product(u, u))) FROM
          (SELECT n, list_transform(m, lambda r: list_dot_product(r, v)) AS u FROM p, {m} WHERE n < {rounds})) SELECT v FROM p ORDER BY n DESC LIMIT 1)"""  # noqa: E731
    sign = "list_transform(v, lambda e: e * CASE WHEN v[list_position(list_transform(v, lambda y: abs(y) >= list_max(list_transform(v, lambda w: abs(w))) * (1 - 1e-9)), true)] < 0 THEN -1 ELSE 1 END)"
    steps = {
        "centred": f"SELECT state, [{', '.join(f'coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()' for c in cols)}] AS c FROM {table}",
        "cells": f"SELECT i, j, avg(c[i] * c[j]) AS v FROM centred, range(1, {d + 1}) AS a(i), range(1, {d + 1}) AS b(j) GROUP BY i, j",
        "m1": "SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM cells GROUP BY i)",
        "v1": loop("m1"),
        "l1": "SELECT list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS e, v FROM v1, m1",
        "m2": "SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(cells.v - l1.e * l1.v[i] * l1.v[j] ORDER BY j) AS r FROM cells, l1 GROUP BY i)",
        "v2": loop("m2"),
        "s1": f"SELECT {sign} AS v FROM v1",
        "s2": f"SELECT {sign} AS v FROM v2",
    }
    return _steps(steps, "SELECT state, list_dot_product(c, s1.v) AS x, list_dot_product(c, s2.v) AS y FROM centred, s1, s2")


def forest_sql(points: str, dims: int, trees: int = 100, sample: int = 256, levels: int = 8, seed: int = 42, contamination: float = 0.1) -> str:
    """All draws from digests, ``levels`` levels of nodes by grouped minima and maxima, and the walk of every row through every tree."""
    draw = lambda *parts: f"(CAST('0x' || md5(concat_ws('|', {', '.join(parts)}))[1:13] AS BIGINT) / {float(1 << 52)})"
    every = range(dims)
    x = "[" + ", ".join(f"x{i}" for i in every) + "]"
    path = lambda n: f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2.0 * (ln({n} - 1.0) + {EULER_GAMMA}) - 2.0 * ({n} - 1.0) / {n} END"
    steps = {
        "pts": f"SELECT state, year_month, {x} AS x FROM {points}",
        "size": f"SELECT least({sample}, count(*)) AS psi, ceil(log2(greatest(least({sample}, count(*)), 2))) AS top FROM pts",
        "l0": f"""SELECT tree, 1 AS node, x FROM pts, range({trees}) AS t(tree)
            QUALIFY row_number() OVER (PARTITION BY tree ORDER BY {draw(str(seed), 'tree', 'state', 'year_month')}, state, year_month) <= {sample}""",
    }
    for k in range(levels + 1):
        low, high = (f"[{', '.join(f'{f}(x[{i + 1}])' for i in every)}]" for f in ("min", "max"))
        steps[f"s{k}"] = f"""SELECT *, CASE WHEN f IS NOT NULL THEN lo[f] + {draw(str(seed), 'tree', 'node', "'bound'")} * (hi[f] - lo[f]) END AS bound FROM (
            SELECT *, CASE WHEN n > 1 AND {k} < top THEN usable[CAST(floor({draw(str(seed), 'tree', 'node', "'feature'")} * len(usable)) AS BIGINT) + 1] END AS f FROM (
            SELECT *, list_filter({[i + 1 for i in every]}, lambda i: hi[i] > lo[i]) AS usable FROM (
            SELECT tree, node, count(*) AS n, {low} AS lo, {high} AS hi FROM l{k} GROUP BY tree, node), size))"""
        if k < levels:
            steps[f"l{k + 1}"] = f"SELECT tree, 2 * node + CASE WHEN x[f] > bound THEN 1 ELSE 0 END AS node, x FROM l{k} JOIN s{k} USING (tree, node) WHERE f IS NOT NULL"
    steps["nodes"] = " UNION ALL ".join(f"SELECT tree, node, f, bound, {k} + {path('n')} AS depth FROM s{k}" for k in range(levels + 1))
    last = f"(SELECT state, year_month, x, tree, 1 AS node FROM pts, range({trees}) AS t(tree))"
    for k in range(levels):
        steps[f"w{k}"] = f"SELECT state, year_month, x, tree, CASE WHEN f IS NULL THEN node WHEN x[f] > bound THEN 2 * node + 1 ELSE 2 * node END AS node FROM {last} JOIN nodes USING (tree, node)"
        last = f"w{k}"
    steps["scores"] = f"SELECT state, year_month, round(pow(2, -(sum(depth) / {trees}) / any_value({path('psi')})), 12) AS anomaly_score FROM {last} JOIN nodes USING (tree, node), size GROUP BY state, year_month"
    return _steps(steps, f"SELECT state, year_month, anomaly_score, CASE WHEN anomaly_score > (SELECT quantile_cont(anomaly_score, {1 - contamination}) FROM scores) THEN 1 ELSE 0 END AS is_anomaly FROM scores")
