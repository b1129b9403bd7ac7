"""DuckDB SQL for the richness fits: each least-squares problem as sums and the closed solution of its normal equations."""

from __future__ import annotations


#: steps of the quotient's refinement
STEPS = 50


def _solve3(a: list[str], r: list[str]) -> list[str]:
    """The solution of a symmetric system by determinants; a: 11, 12, 13, 22, 23, 33."""
    p, q, s, t, u, v = a
    x, y, z = r
    det = f"({p} * ({t} * {v} - {u} * {u}) - {q} * ({q} * {v} - {u} * {s}) + {s} * ({q} * {u} - {t} * {s}))"
    return [
        f"({x} * ({t} * {v} - {u} * {u}) - {q} * ({y} * {v} - {u} * {z}) + {s} * ({y} * {u} - {t} * {z})) / {det}",
        f"({p} * ({y} * {v} - {z} * {u}) - {x} * ({q} * {v} - {u} * {s}) + {s} * ({q} * {z} - {y} * {s})) / {det}",
        f"({p} * ({t} * {z} - {u} * {y}) - {q} * ({q} * {z} - {y} * {s}) + {x} * ({q} * {u} - {t} * {s})) / {det}",
    ]


def _normal(columns: list[str], target: str) -> str:
    """The sums of a system of three columns, weighted by w2."""
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    sums = [f"sum(w2 * {columns[i]} * {columns[k]}) AS a{n}" for n, (i, k) in enumerate(pairs)]
    return ", ".join(sums + [f"sum(w2 * {c} * {target}) AS r{n}" for n, c in enumerate(columns)])


_A, _R = [f"a{n}" for n in range(6)], [f"r{n}" for n in range(3)]
_ERROR = "CASE WHEN unseen >= 0 AND isfinite(unseen) THEN {n} + unseen END AS estimate, CASE WHEN unseen >= 0 AND isfinite(unseen) THEN sqrt(unseen * unseen * (1 / f1 + rel) + {n} * unseen / ({n} + unseen)) END AS error"


def fits(table: str, keys: str, cutoff: int = 10) -> str:
    """SELECT keys, model, estimate, error of every model for the histograms in `table`; keys may be null."""
    names = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"t.{k} IS NOT DISTINCT FROM gr.{k}" for k in names)
    b = _solve3(_A, _R)
    steps = ", ".join(f"{x} AS d{n}" for n, x in enumerate(b))
    poisson = (
        "SELECT g, '{name}' AS model, c + top AS estimate, sqrt(c / (exp(a) - 1 - a)) AS error FROM (SELECT *, low / (1 - exp(-a)) AS c FROM (SELECT *, CASE WHEN tot > low THEN "
        "list_reduce(list_prepend(tot / low, list_transform(range(300), lambda i: tot / low)), lambda x, m: m * (1 - exp(-x))) END AS a FROM (SELECT g, coalesce(sum(f) FILTER (WHERE {k} <= "
        + str(cutoff) + "), 0) AS low, coalesce(sum({k} * f) FILTER (WHERE {k} <= " + str(cutoff) + "), 0) AS tot, coalesce(sum(f) FILTER (WHERE {k} > " + str(cutoff) + "), 0) AS top FROM hh WHERE {where} GROUP BY g)))"
    )
    return f"""
    WITH RECURSIVE tt AS (SELECT * FROM {table}),
    gr AS (SELECT *, row_number() OVER () AS g FROM (SELECT DISTINCT {keys} FROM tt)),
    hh AS (SELECT g, CAST(sample_count AS DOUBLE) AS k, CAST(sum(species_count) AS DOUBLE) AS f FROM tt t JOIN gr ON {same} GROUP BY g, sample_count),
    nn AS (SELECT g, sum(f) AS n, coalesce(sum(f) FILTER (WHERE k = 1), 0) AS f1 FROM hh GROUP BY g),
    rr AS (SELECT g, k, f, bool_and(k = p AND f > 0) OVER (PARTITION BY g ORDER BY k) AS unbroken FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) AS p FROM hh)),
    ra AS (SELECT g, k AS j, f2 / f AS y, 1 / f2 + 1 / f AS v, 1 / ((f2 / f) * (f2 / f) * (1 / f2 + 1 / f)) AS w2 FROM (SELECT *, lead(f) OVER (PARTITION BY g ORDER BY k) AS f2 FROM rr WHERE unbroken) WHERE f2 IS NOT NULL),
    wl AS (SELECT g, count(*) AS m, sum(1 / v) AS s0, sum(j / v) AS s1, sum(j * j / v) AS s2, sum(ln(y * (j + 1)) / v) AS t0, sum(j * ln(y * (j + 1)) / v) AS t1 FROM ra GROUP BY g HAVING count(*) >= 2),
    wr AS (SELECT g, f1 * exp(-(s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1)) AS unseen, s2 / (s0 * s2 - s1 * s1) AS rel, n, f1 FROM wl JOIN nn USING (g)),
    kl AS (SELECT g, count(*) AS m, max(j) AS top, sum(w2) AS s0, sum(w2 * j) AS s1, sum(w2 * j * j) AS s2, sum(w2 * y) AS t0, sum(w2 * j * y) AS t1 FROM ra GROUP BY g HAVING count(*) >= 3),
    kb AS (SELECT *, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS b0, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS b1, s2 / (s0 * s2 - s1 * s1) AS cover FROM kl),
    k1 AS (SELECT g, 2 AS terms, b0, any_value(cover) AS cover, sum(w2 * (y - b0 - b1 * j) * (y - b0 - b1 * j)) AS squares, count(*) AS m FROM kb JOIN ra USING (g) WHERE b0 > 0 AND b0 + b1 > 0 AND b0 + b1 * top > 0 GROUP BY g, b0),
    q0 AS (SELECT g, {_normal(["1", "j", "(-j * y)"], "y")} FROM ra GROUP BY g HAVING count(*) >= 4),
    qi AS (
      SELECT g, 0 AS i, {", ".join(f"{x} AS b{n}" for n, x in enumerate(b))}, 1.0::DOUBLE AS moved FROM q0
      UNION ALL
      SELECT g, i + 1, b0 + d0, b1 + d1, b2 + d2, greatest(abs(d0), abs(d1), abs(d2)) / (1 + greatest(abs(b0), abs(b1), abs(b2))) FROM (SELECT *, {steps} FROM (SELECT g, i, b0, b1, b2, {_normal(["(1 / u)", "(j / u)", "(-j * t / u)"], "(y - t)")}
        FROM (SELECT qi.*, j, y, w2, 1 + b2 * j AS u, (b0 + b1 * j) / (1 + b2 * j) AS t FROM qi JOIN ra USING (g) WHERE i < {STEPS}) GROUP BY g, i, b0, b1, b2))),
    k2 AS (
      SELECT g, 3 AS terms, b0, (a3 * a5 - a4 * a4) / (a0 * (a3 * a5 - a4 * a4) - a1 * (a1 * a5 - a4 * a2) + a2 * (a1 * a4 - a3 * a2)) AS cover, squares, m
      FROM (SELECT g, b0, {_normal(["(1 / u)", "(j / u)", "(-j * t / u)"], "(y - t)")}, sum(w2 * (y - t) * (y - t)) AS squares, count(*) AS m, min(u) AS low_u, min(t) AS low_t
        FROM (SELECT qi.*, j, y, w2, 1 + b2 * j AS u, (b0 + b1 * j) / (1 + b2 * j) AS t FROM qi JOIN ra USING (g) WHERE i = {STEPS} AND moved < 1e-8 AND isfinite(b0) AND isfinite(b1) AND isfinite(b2)) GROUP BY g, b0)
      WHERE b0 > 0 AND low_u > 0 AND low_t > 0),
    kk AS (SELECT g, f1 / b0 AS unseen, cover * greatest(1, squares / (m - terms)) / (b0 * b0) AS rel, n, f1 FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY squares + 2 * terms, terms) AS p FROM (FROM k1 UNION ALL FROM k2)) JOIN nn USING (g) WHERE p = 1),
    cb AS (SELECT g, coalesce(sum(f) FILTER (WHERE k > {cutoff}), 0) AS top, coalesce(sum(f) FILTER (WHERE k <= {cutoff} AND k > 1), 0) AS more, 1 - coalesce(sum(f) FILTER (WHERE k = 1), 0) * sum(k * k * f) FILTER (WHERE k <= {cutoff}) / nullif(sum(k * f) FILTER (WHERE k <= {cutoff}), 0) ** 2 AS coverage FROM hh GROUP BY g),
    mm AS (
      SELECT g, 'observed' AS model, n AS estimate, 0.0::DOUBLE AS error FROM nn
      UNION ALL SELECT g, 'kemp', {_ERROR.format(n="n")} FROM nn LEFT JOIN (SELECT g, unseen, rel FROM kk) USING (g)
      UNION ALL SELECT g, 'weighted_ratio', {_ERROR.format(n="n")} FROM nn LEFT JOIN (SELECT g, unseen, rel FROM wr) USING (g)
      UNION ALL SELECT g, 'chao_bunge', CASE WHEN coverage > 0 THEN top + more / coverage END, NULL FROM cb
      UNION ALL {poisson.format(name="poisson", k="k", where="true")}
      UNION ALL SELECT g, 'no_f1', x.estimate, x.error FROM nn LEFT JOIN ({poisson.format(name="no_f1", k="(k - 1)", where="k > 1")}) x USING (g))
    SELECT {keys}, model, estimate, error FROM mm JOIN gr USING (g)"""


ORDER = ("kemp", "weighted_ratio", "chao_bunge", "poisson")


def selected(table: str, keys: str) -> str:
    """SELECT keys, model, estimate, error of the first model in order that fits."""
    rank = f"list_position({list(ORDER)!r}, model)"
    ok = f"FILTER (WHERE {rank} > 0 AND estimate IS NOT NULL)"
    return f"SELECT {keys}, " + ", ".join(f"arg_min({c}, {rank}) {ok} AS {c}" for c in ("model", "estimate", "error")).replace("arg_min(error,", "arg_min_null(error,") + f" FROM ({fits(table, keys)}) GROUP BY {keys}"


