"""Drift, regime, cross-validation and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorframe.operators import crossval as C
from factorframe.operators import drift as D
from factorframe.operators import quality as V
from factorframe.operators import regime as G
from factorframe.operators.ic import daily_rank_ic, unpivot_features
from factorframe.plans.factor_queries import _INDEX, index_close
from factorframe.plans.ic_queries import FACTOR_CTE, FACTORS, factor_frame
from factorframe.plans.registry import query
from factorframe.plans.sql import ICIR_COLUMNS, sql_icir, sql_ranks
from factorframe.plans.testbed import with_ctes

SPLIT = "1998-07-01"

# ---- drift -----------------------------------------------------------------------------------------------------------

_LONG = f"""fd AS MATERIALIZED (SELECT feature, value, date < DATE '{SPLIT}' AS base FROM
  (UNPIVOT (SELECT * EXCLUDE (label) FROM fx) ON {', '.join(FACTORS)} INTO NAME feature VALUE value) u),
qe AS MATERIALIZED (SELECT feature, list_sort(list_distinct(quantile_cont(value,
  [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM fd WHERE base GROUP BY feature),
bins AS (SELECT feature, unnest(range(1, len(e))) AS b FROM qe),
placed AS (SELECT fd.feature, base, least(len(list_filter(e, lambda x: x <= value)), len(e) - 1) AS b FROM fd JOIN qe USING (feature)
           WHERE value BETWEEN e[1] AND e[len(e)]),
cnt AS (SELECT bins.feature, bins.b, count(CASE WHEN base THEN 1 END) AS ec, count(CASE WHEN NOT base THEN 1 END) AS ac
        FROM bins LEFT JOIN placed ON placed.feature = bins.feature AND placed.b = bins.b GROUP BY bins.feature, bins.b),
shr AS (SELECT feature, greatest(ec / sum(ec) OVER p, 1e-6) AS e1, greatest(ac / sum(ac) OVER p, 1e-6) AS a1 FROM cnt
        WINDOW p AS (PARTITION BY feature)),
nrm AS (SELECT feature, e1 / sum(e1) OVER p AS e2, a1 / sum(a1) OVER p AS a2 FROM shr WINDOW p AS (PARTITION BY feature)),
pt AS MATERIALIZED (SELECT feature, sum((a2 - e2) * ln(a2 / e2)) AS psi FROM nrm GROUP BY feature)"""
_PSI = with_ctes("wk", extra=FACTOR_CTE + ",\n" + _LONG)


def _halves(t):
    rows = factor_frame(t).drop("label")
    cut = F.lit(SPLIT).cast("date")
    return rows.where(F.col("date") < cut), rows.where(F.col("date") >= cut)


@query("psi", {"feature": "str", "psi": 7}, _PSI + "SELECT * FROM pt")
def psi(t):
    return D.psi(*_halves(t), FACTORS)


@query(
    "psi_table",
    {"feature": "str", "psi": 7, "drift_level": "str"},
    _PSI + """SELECT feature, psi, CASE WHEN psi < 0.1 THEN 'low' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END AS drift_level
              FROM pt""",
)
def psi_table(t):
    return D.psi_table(*_halves(t), FACTORS)


_ROLL = """cd0 AS (SELECT date, ic, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n,
    CASE WHEN count(ic) OVER w >= 24 THEN avg(ic) OVER w END AS rolling_ic,
    CASE WHEN count(ic) OVER w >= 24 THEN stddev_samp(ic) OVER w END AS rolling_std
  FROM ic WINDOW w AS (ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
cd1 AS (SELECT *, CASE WHEN count(rolling_ic) OVER w >= 24 THEN regr_slope(rolling_ic, i) OVER w END AS trend,
    avg(CASE WHEN i >= 24 AND i < 48 THEN rolling_ic END) OVER () AS b, avg(CASE WHEN i >= n - 24 THEN rolling_ic END) OVER () AS r
  FROM cd0 WINDOW w AS (ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


@query(
    "concept_drift",
    {"date": "date", "ic": 7, "rolling_ic": 7, "rolling_std": 7, "trend": 8, "drift_warning": "bool"},
    with_ctes("ic", extra=_ROLL) + """SELECT date, ic, rolling_ic, rolling_std, trend,
      coalesce(i >= n - 24 AND n > 24 AND b > 0 AND (b - r) / b > 0.3, false) AS drift_warning FROM cd1""",
)
def concept_drift(t):
    return D.concept_drift(daily_rank_ic(t.scored), window=24)


_IMP = """imp AS (SELECT year(date) - 1995 AS fold, feature, abs(corr(value, label)) AS importance FROM fl
  GROUP BY 1, 2 HAVING isfinite(corr(value, label))),
ip AS (SELECT a.fold, a.importance AS x, b.importance AS y FROM imp a JOIN imp b ON b.fold = a.fold + 1 AND b.feature = a.feature)"""


def yearly_importance(t):
    """Absolute correlation with the label per feature and year: a fold -> importance table."""
    from factorframe.functions.stats import correlation

    long = unpivot_features(factor_frame(t).where(F.col("label").isNotNull()), FACTORS, ["date", "label"])
    return long.groupBy((F.year("date") - 1995).alias("fold"), "feature").agg(
        F.abs(correlation("value", "label")).alias("importance")
    ).where(F.col("importance").isNotNull())


_STAB = with_ctes("wk", extra=FACTOR_CTE + ",\n" + _IMP + f""",
  rr AS (SELECT fold, corr(rx, ry) AS rho FROM {sql_ranks('ip', 'fold', {'x': 'rx', 'y': 'ry'}, 'fold')} q GROUP BY fold HAVING count(*) > 5),
  st AS (SELECT (SELECT count(DISTINCT fold) FROM imp) AS n_folds, (SELECT count(rho) FROM rr) AS n_pairs,
         coalesce((SELECT avg(rho) FROM rr), 0) AS stability)""")


@query("importance_stability", {"n_folds": "int", "n_pairs": "int", "stability": 6}, _STAB + "SELECT * FROM st")
def importance_stability(t):
    return D.importance_stability(yearly_importance(t))


@query(
    "drift_report",
    {"n_features": "int", "n_significant": "int", "n_moderate": "int", "top_features": "str", "n_warnings": "int",
     "recent_rolling_ic": 6, "stability": 6, "status": "str"},
    with_ctes("wk", "ic", extra=FACTOR_CTE + ",\n" + _LONG + ",\n" + _ROLL + ",\n" + _STAB[_STAB.index("imp AS"):])
    + """SELECT (SELECT count(*) FROM pt) AS n_features, (SELECT count(*) FROM pt WHERE psi >= 0.25) AS n_significant,
      (SELECT count(*) FROM pt WHERE psi >= 0.1 AND psi < 0.25) AS n_moderate,
      (SELECT string_agg(feature, ',' ORDER BY psi DESC, feature) FROM pt) AS top_features,
      (SELECT count(*) FROM cd1 WHERE i >= n - 24 AND n > 24 AND b > 0 AND (b - r) / b > 0.3) AS n_warnings,
      (SELECT arg_max(rolling_ic, date) FROM cd1) AS recent_rolling_ic, stability,
      CASE WHEN stability > 0.7 THEN 'stable' WHEN stability > 0.5 THEN 'warning' ELSE 'critical' END AS status FROM st""",
)
def drift_report(t):
    t.keep("week")  # factors and scores both start there
    table = D.psi(*_halves(t), FACTORS).withColumn(
        "drift_level", F.when(F.col("psi") < 0.1, "low").when(F.col("psi") < 0.25, "moderate").otherwise("significant")
    )
    return D.drift_report(table, D.concept_drift(daily_rank_ic(t.scored), 24), D.importance_stability(yearly_importance(t)))


# ---- regimes ---------------------------------------------------------------------------------------------------------

_REGIME = _INDEX + """,
rg0 AS (SELECT date, close AS price, close / lag(close) OVER (ORDER BY date) - 1 AS ret,
    CASE WHEN count(close) OVER w >= 12 THEN avg(close) OVER w END AS ma FROM ix
  WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
rg1 AS (SELECT *, CASE WHEN count(ret) OVER w >= 12 THEN stddev_samp(ret) OVER w END AS vol FROM rg0
  WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
rg2 AS (SELECT *, CASE WHEN count(vol) OVER w >= 24 THEN median(vol) OVER w END AS vm FROM rg1
  WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
rg AS MATERIALIZED (SELECT date, price, ma, vol, CASE WHEN price > ma AND vol < vm THEN 'bull' WHEN price > ma THEN 'strong_bull'
    WHEN vol < vm THEN 'bear' ELSE 'strong_bear' END AS regime FROM rg2
  WHERE price IS NOT NULL AND ma IS NOT NULL AND vol IS NOT NULL AND vm IS NOT NULL)"""


@query("classify_regime", {"date": "date", "price": 2, "ma": 2, "vol": 7, "regime": "str"}, with_ctes("bench", extra=_REGIME) + "SELECT * FROM rg")
def classify_regime(t):
    return G.classify_regime(index_close(t), 12, 12)


@query(
    "regime_ic",
    {"regime": "str", "n_days": "int", "ic_mean": 7, "ic_std": 7, "icir": 6, "ic_positive_ratio": 7},
    with_ctes("bench", "ic", extra=_REGIME) + """SELECT regime, count(*) AS n_days, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std,
      avg(ic) / stddev_samp(ic) AS icir, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS ic_positive_ratio
      FROM ic JOIN rg USING (date) GROUP BY regime HAVING count(*) > 5""",
)
def regime_ic(t):
    return G.regime_ic(daily_rank_ic(t.scored), G.classify_regime(index_close(t), 12, 12))


@query(
    "key_years",
    {"year": "int", "n_days": "int", "ic_mean": 7, "icir": 6, "total_return": 6, "bench_return": 6},
    with_ctes("bench", "ic") + """SELECT y AS year, n_days, ic_mean, icir, total_return, bench_return FROM
      (SELECT year(date) AS y, count(*) AS n_days, avg(ic) AS ic_mean, avg(ic) / stddev_samp(ic) AS icir FROM ic
       WHERE year(date) IN (1996, 1998, 2000) GROUP BY 1) a LEFT JOIN
      (SELECT year(date) AS y, product(1 + bench / 50) - 1 AS total_return, product(1 + bench / 100) - 1 AS bench_return FROM bench GROUP BY 1) b
      USING (y)""",
)
def key_years(t):
    returns = t.benchmark.select("date", (F.col("bench") / 50).alias("return"), (F.col("bench") / 100).alias("bench"))
    return G.key_years(daily_rank_ic(t.scored), returns, (1996, 1998, 2000))


@query(
    "benchmark_validate",
    {"n_rows": "int", "first_date": "date", "last_date": "date", "covered": "bool", "longest_flat_run": "int", "passed": "bool"},
    with_ctes("bench", extra=_INDEX + """, m AS (SELECT date, close, CASE WHEN lag(close) OVER (ORDER BY date) = close THEN 0 ELSE 1 END AS new FROM ix),
      g AS (SELECT *, sum(new) OVER (ORDER BY date) AS run FROM m), l AS (SELECT max(c) AS longest FROM (SELECT count(*) AS c FROM g GROUP BY run) q)""")
    + """SELECT count(close) AS n_rows, min(date) AS first_date, max(date) AS last_date,
      min(date) <= DATE '1996-01-01' AND max(date) >= DATE '2001-01-01' AS covered, min(longest) AS longest_flat_run,
      min(date) <= DATE '1996-01-01' AND max(date) >= DATE '2001-01-01' AND min(longest) < 5 AS passed FROM ix, l""",
)
def benchmark_validate(t):
    return G.benchmark_check(index_close(t), "1996-01-01", "2001-01-01")


# ---- cross-validation ------------------------------------------------------------------------------------------------

_FOLDS = """nn AS (SELECT count(*) AS n FROM cal),
fb AS (SELECT k AS fold, floor(n * k / 5.0) AS f, floor(n * (k + 1) / 5.0) - 1 AS l FROM nn, range(5) r(k)),
blk AS (SELECT fold, f, l, min(date) AS ts, max(date) AS te FROM cal JOIN fb ON idx BETWEEN f AND l GROUP BY fold, f, l),
sp AS MATERIALIZED (SELECT * FROM (SELECT fold, date, CASE WHEN idx BETWEEN f AND l THEN 'test'
    WHEN date + 28 < ts - 28 OR date > te + 14 THEN 'train' END AS role FROM cal, blk) q WHERE role IS NOT NULL)"""


@query("purged_kfold", {"fold": "int", "date": "date", "role": "str"}, with_ctes("cal", extra=_FOLDS) + "SELECT * FROM sp")
def purged_kfold(t):
    return C.purged_kfold(t.calendar, 5, 20)


@query(
    "walk_forward",
    {"fold": "int", "train_start": "date", "train_end": "date", "valid_start": "date", "valid_end": "date", "test_start": "date",
     "test_end": "date"},
    with_ctes("cal", extra="""b AS (SELECT min(date) AS s, max(date) AS e FROM cal),
      st AS (SELECT k, CAST(s + to_months(CAST(k * 6 AS INTEGER)) AS DATE) AS ts, e FROM b, range(40) r(k)),
      w AS (SELECT k, ts, e, CAST(ts + INTERVAL 24 MONTH AS DATE) AS a FROM st),
      x AS (SELECT *, CAST(a + INTERVAL 12 MONTH AS DATE) AS c FROM w)""")
    + """SELECT k AS fold, ts AS train_start, a - 28 AS train_end, a - 28 AS valid_start, least(c - 28, e) AS valid_end, c - 28 AS test_start,
      least(CAST(c + INTERVAL 12 MONTH AS DATE), e) AS test_end FROM x WHERE c < e""",
)
def walk_forward(t):
    span = t.calendar.agg(F.min("date").alias("s"), F.max("date").alias("e"))
    return C.walk_forward(t.spark, F.col("s"), F.col("e"), 2.0, 6, 1.0, 20, source=span)


@query(
    "cv_evaluate",
    {"fold": "int", **ICIR_COLUMNS},
    with_ctes("ic", "cal", extra=_FOLDS + ", fic AS MATERIALIZED (SELECT fold, date, ic FROM ic JOIN sp USING (date) WHERE role = 'test')")
    + f"SELECT * FROM {sql_icir('fic', 'fold', '4')} q",
)
def cv_evaluate(t):
    return C.cv_evaluate(t.scored, C.purged_kfold(t.calendar, 5, 20), 4)


@query(
    "min_train_guard",
    {"fold": "int", "date": "date", "role": "str"},
    with_ctes("cal", extra=_FOLDS) + "SELECT * FROM sp WHERE fold IN (SELECT fold FROM sp WHERE role = 'train' GROUP BY fold HAVING count(*) >= 276)",
)
def min_train_guard(t):
    return C.min_train_guard(C.purged_kfold(t.calendar, 5, 20), 276)


# ---- data quality ----------------------------------------------------------------------------------------------------

# line items as bars with faults: repeated dates, and prices outside the range
_RAW = """raw AS MATERIALIZED (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, px * (1 + l_tax / 2) AS open,
    px * (1 + l_discount) AS high, px * (1 - l_discount) AS low, px * (1 + l_tax) AS close,
    CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem) l)"""


def faulty_bars(t):
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return t.read("lineitem").select(
        F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("date"), (px * (1 + F.col("l_tax") / 2)).alias("open"),
        (px * (1 + F.col("l_discount"))).alias("high"), (px * (1 - F.col("l_discount"))).alias("low"),
        (px * (1 + F.col("l_tax"))).alias("close"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity")).alias("volume"),
    )


@query(
    "check_required",
    {"missing_columns": "str", "n_rows": "int", "bad_dates": "int", "passed": "bool"},
    """SELECT 'volume' AS missing_columns, count(*) AS n_rows, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS bad_dates,
              false AS passed FROM lineitem""",
)
def check_required(t):
    bars = t.read("lineitem").withColumn("text", F.when(F.col("l_returnflag") == "R", "n/a").otherwise(F.col("l_shipdate").cast("date").cast("string")))
    prices = [F.lit(1.0).alias(c) for c in ("open", "high", "low", "close")]
    return V.check_required(bars.select(F.col("l_suppkey").alias("code"), F.col("text").alias("date"), *prices))


@query(
    "check_duplicates",
    {"code": "int", "extra_rows": "int", "all_rows": "int"},
    f"""WITH {_RAW} SELECT code, sum(c - 1) AS extra_rows, sum(c) AS all_rows FROM (SELECT code, date, count(*) AS c FROM raw GROUP BY code, date) q
        WHERE c > 1 GROUP BY code""",
)
def check_duplicates(t):
    return V.duplicates(faulty_bars(t))


@query(
    "check_ohlc",
    {"code": "int", "type": "str", "n": "int", "sample_dates": "str"},
    f"""WITH {_RAW} SELECT code, type, count(*) AS n, array_to_string(list_sort(list(DISTINCT date))[1:5], ',') AS sample_dates FROM (
        SELECT code, date, 'low_gt_high' AS type FROM raw WHERE low > high
        UNION ALL SELECT code, date, 'open_out_of_range' FROM raw WHERE open < low OR open > high
        UNION ALL SELECT code, date, 'close_out_of_range' FROM raw WHERE close < low OR close > high) q GROUP BY code, type""",
)
def check_ohlc(t):
    return V.check_ohlc(faulty_bars(t))


_FIRST = """fb1 AS (SELECT code, date, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY code, date
    ORDER BY open, high, low, close, volume) AS rn FROM raw) q WHERE rn = 1),
fb2 AS MATERIALIZED (SELECT *, lag(close) OVER w AS prev_close, close / lag(close) OVER w - 1 AS change, close - lag(close) OVER w AS move
    FROM fb1 WINDOW w AS (PARTITION BY code ORDER BY date))"""


@query(
    "check_price_jump",
    {"code": "int", "date": "date", "close": 9, "prev_close": 9, "change": 8},
    f"WITH {_RAW}, {_FIRST} SELECT code, date, close, prev_close, change FROM fb2 WHERE abs(change) > 0.2",
)
def check_price_jump(t):
    return V.price_jumps(V.first_bars(faulty_bars(t)))


@query(
    "check_zero_volume_move",
    {"code": "int", "date": "date", "close": 9, "volume": 4, "move": 9},
    f"WITH {_RAW}, {_FIRST} SELECT code, date, close, volume, move FROM fb2 WHERE volume = 0 AND abs(move) > 0.001",
)
def check_zero_volume_move(t):
    return V.zero_volume_moves(V.first_bars(faulty_bars(t)))


_ISSUES = f"""{_RAW}, {_FIRST}, dd AS (SELECT code, date, count(*) AS c FROM raw GROUP BY code, date),
ev AS (SELECT code, date, 'duplicate_dates' AS type, 'warning' AS severity, c - 1 AS k FROM dd WHERE c > 1
  UNION ALL SELECT code, date, 'duplicate_rows', 'error', c FROM dd WHERE c > 1
  UNION ALL SELECT code, date, 'low_gt_high', 'error', 1 FROM raw WHERE low > high
  UNION ALL SELECT code, date, 'open_out_of_range', 'error', 1 FROM raw WHERE open < low OR open > high
  UNION ALL SELECT code, date, 'close_out_of_range', 'error', 1 FROM raw WHERE close < low OR close > high
  UNION ALL SELECT code, date, 'extreme_price_jump', 'warning', 1 FROM fb2 WHERE abs(change) > 0.2
  UNION ALL SELECT code, date, 'zero_vol_price_change', 'warning', 1 FROM fb2 WHERE volume = 0 AND abs(move) > 0.001),
iss AS MATERIALIZED (SELECT code, type, severity, sum(k) AS n, array_to_string(list_slice(list_sort(list(DISTINCT date)), 1, 5), ',') AS sample_dates
  FROM ev GROUP BY code, type, severity)"""


@query(
    "validate_panel",
    {"code": "int", "type": "str", "severity": "str", "n": "int", "sample_dates": "str"},
    f"WITH {_ISSUES} SELECT * FROM iss",
)
def validate_panel(t):
    return V.validate_panel(faulty_bars(t))


@query(
    "validation_summary",
    {"code": "int", "n_rows": "int", "first_date": "date", "last_date": "date", "n_issues": "int", "passed": "bool"},
    f"""WITH {_ISSUES} SELECT r.code, n_rows, first_date, last_date, coalesce(k, 0) AS n_issues, k IS NULL AS passed FROM
        (SELECT code, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM raw GROUP BY code) r
        LEFT JOIN (SELECT code, count(*) AS k FROM iss GROUP BY code) i ON i.code = r.code""",
)
def validation_summary(t):
    return V.validation_summary(faulty_bars(t), V.validate_panel(faulty_bars(t)))


@query(
    "issue_counts",
    {"severity": "str", "type": "str", "n_issues": "int", "n_rows": "int"},
    f"WITH {_ISSUES} SELECT severity, type, count(*) AS n_issues, sum(n) AS n_rows FROM iss GROUP BY ROLLUP (severity, type)",
)
def issue_counts(t):
    return V.issue_counts(V.validate_panel(faulty_bars(t)))


@query(
    "detect_adjust_events",
    {"code": "int", "date": "date", "prev_close": 9, "close": 9, "change": 8},
    with_ctes("panel_day") + """SELECT code, date, prev_close, close, close / prev_close - 1 AS change FROM
      (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) AS prev_close FROM panel_day) q WHERE abs(close / prev_close - 1) > 0.11""",
)
def detect_adjust_events(t):
    return V.adjust_events(t.day)


@query(
    "coverage_check",
    {"n_codes": "int", "n_dates": "int", "passed": "bool"},
    with_ctes("panel_day") + "SELECT count(DISTINCT code) AS n_codes, count(DISTINCT date) AS n_dates, count(DISTINCT date) >= 10 AS passed FROM panel_day",
)
def coverage_check(t):
    return V.coverage(t.day)
