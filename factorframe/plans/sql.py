"""SQL text shared by the second-engine queries."""

from __future__ import annotations

from factorframe.operators.significance import ERF_A, ERF_P


def sql_normal_cdf(x: str) -> str:
    t = f"(1.0 / (1.0 + {ERF_P} * abs({x}) / sqrt(2.0)))"
    poly = " + ".join(f"({a} * pow({t}, {i}))" for i, a in enumerate(ERF_A, 1))
    erf = f"(1.0 - ({poly}) * exp(-({x}) * ({x}) / 2.0))"
    return f"(CASE WHEN {x} >= 0 THEN (1.0 + {erf}) / 2 ELSE (1.0 - {erf}) / 2 END)"


def sql_newey_west(source: str, value: str, by: str | None = None, lags: str | None = None, order: str = "date") -> str:
    """Subquery with one row per series: by, n_samples, mean, std, lags, nw_se, t_naive, t_nw, p_naive, p_nw."""
    key = by or "0"
    lag_text = lags or "floor(pow(count(*) OVER (PARTITION BY g), 0.25))"
    return f"""(
      WITH e0 AS (SELECT {key} AS g, {order} AS o, {value} AS x{', ' + lags + ' AS lagcol' if lags and not lags.isdigit() else ''}
                  FROM {source} WHERE {value} IS NOT NULL),
      e1 AS (SELECT g, o, x, x - avg(x) OVER (PARTITION BY g) AS e, row_number() OVER (PARTITION BY g ORDER BY o) AS i,
                    count(*) OVER (PARTITION BY g) AS n,
                    greatest(1, least({'lagcol' if lags and not lags.isdigit() else lag_text},
                                      count(*) OVER (PARTITION BY g) - 1)) AS l FROM e0),
      c AS (SELECT a.g, sum(CASE WHEN a.i = b.i THEN a.e * b.e
                                 ELSE 2.0 * (1.0 - (b.i - a.i) / (a.l + 1.0)) * a.e * b.e END) AS v
            FROM e1 a JOIN e1 b ON a.g = b.g AND b.i - a.i BETWEEN 0 AND a.l GROUP BY a.g),
      m AS (SELECT g, count(*) AS n_samples, avg(x) AS mean, stddev_samp(x) AS std, max(l) AS lags,
                   avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS pos FROM e1 GROUP BY g),
      s AS (SELECT m.*, CASE WHEN n_samples >= 2 THEN sqrt(greatest(v / n_samples, 0.0) / n_samples) ELSE 0.0 END AS nw_se,
                   CASE WHEN std > 0 THEN mean / (std / sqrt(n_samples)) ELSE 0.0 END AS t_naive
            FROM m JOIN c ON m.g = c.g),
      t AS (SELECT *, CASE WHEN nw_se > 0 THEN mean / nw_se ELSE 0.0 END AS t_nw FROM s)
      SELECT {'g AS ' + by + ', ' if by else ''} n_samples, mean, std, lags, pos, nw_se, t_naive, t_nw,
             2.0 * (1.0 - {sql_normal_cdf('abs(t_naive)')}) AS p_naive,
             2.0 * (1.0 - {sql_normal_cdf('abs(t_nw)')}) AS p_nw,
             abs(t_nw) > 2.0 AS significant
      FROM t)"""


def sql_icir(source: str, by: str | None = None, lags: str | None = None, min_days: int = 5) -> str:
    ok = f"n_samples >= {min_days}"
    return f"""(
      SELECT {by + ', ' if by else ''} n_samples AS n_days, CASE WHEN {ok} THEN mean END AS ic_mean,
             CASE WHEN {ok} THEN std END AS ic_std, CASE WHEN {ok} AND std > 0 THEN mean / std END AS icir,
             CASE WHEN {ok} THEN pos END AS ic_positive_ratio,
             CASE WHEN {ok} AND std > 0 THEN t_naive END AS naive_t_stat, CASE WHEN {ok} THEN t_nw END AS nw_t_stat,
             CASE WHEN {ok} THEN p_nw END AS nw_p_value, ({ok} AND significant) AS nw_significant
      FROM {sql_newey_west(source, 'ic', by, lags)} nw)"""


def sql_ranks(source: str, keys: str, columns: dict[str, str], keep: str) -> str:
    """Subquery adding average-tie ranks."""
    ranks = ", ".join(
        f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0 AS {name}"
        for c, name in columns.items()
    )
    return f"(SELECT {keep}, {ranks} FROM {source})"


def sql_rank_ic(source: str, keys: str, score: str = "score", label: str = "label", min_names: int = 3) -> str:
    ranked = sql_ranks(source, keys, {score: "rs", label: "rl"}, keys)
    return f"""(SELECT {keys}, round(corr(rs, rl), 12) AS ic, count(*) AS n FROM {ranked} r GROUP BY {keys}
                HAVING count(*) >= {min_names} AND isfinite(corr(rs, rl)))"""


ICIR_COLUMNS = {
    "n_days": "int", "ic_mean": 7, "ic_std": 7, "icir": 6, "ic_positive_ratio": 7, "naive_t_stat": 5, "nw_t_stat": 5,
    "nw_p_value": 5, "nw_significant": "bool",
}


def sql_system(source: str, key: str, features, target: str) -> str:
    """Subquery: key, n, mean and dev (lists, target last), m (rows of the correlation system) of complete rows."""
    columns = [*features, target]

    def cell(a: str, b: str) -> str:
        return f"coalesce(covar_pop({a}, {b}) / nullif(sqrt(var_pop({a}) * var_pop({b})), 0), 0)"

    rows = ", ".join(f"[{', '.join(cell(a, b) for b in columns)}]" for a in features)
    return f"""(SELECT {key}, count(*) AS n, [{', '.join(f'avg({c})' for c in columns)}] AS mean,
      [{', '.join(f'stddev_pop({c})' for c in columns)}] AS dev, [{rows}] AS m
      FROM {source} WHERE {' AND '.join(f'isfinite({c})' for c in columns)} GROUP BY {key})"""


def sql_solved(name: str, source: str, keys: str, k: int) -> str:
    """Two recursive CTEs: {name}_e eliminates m of source (keys, n, mean, dev, m, allowed) column by column; {name} has coefficients and intercept."""
    reduced = f"""list_transform(m, lambda r, i: list_transform(r, lambda x, j: CASE WHEN i = p THEN x / m[p][p] ELSE x - r[p] * m[p][j] / m[p][p] END))"""
    return f"""{name}_e AS (
      SELECT {keys}, n, mean, dev, allowed, 1 AS p, m, []::BOOLEAN[] AS used FROM {source}
      UNION ALL SELECT {keys}, n, mean, dev, allowed, p + 1, CASE WHEN ok THEN {reduced} ELSE m END, list_append(used, ok)
      FROM (SELECT *, m[p][p] > 1e-10 AND allowed[p] AS ok FROM {name}_e WHERE p <= {k}) q),
    {name} AS MATERIALIZED (
      SELECT *, mean[{k + 1}] - list_sum(list_transform(coefficients, lambda b, i: coalesce(b, 0) * mean[i])) AS intercept
      FROM (SELECT {keys}, n, mean, list_transform(m, lambda r, i: CASE WHEN used[i] THEN r[{k + 1}] * dev[{k + 1}] / dev[i] END) AS coefficients
            FROM {name}_e WHERE p = {k + 1}) q)"""


def sql_score(features) -> str:
    terms = " + ".join(f"coalesce(coefficients[{i}], 0) * {f}" for i, f in enumerate(features, 1))
    return f"intercept + {terms}"
