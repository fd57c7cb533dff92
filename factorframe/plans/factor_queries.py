"""Rolling primitives, factor sets, labels and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorframe.functions import factors as X
from factorframe.functions import rolling as R
from factorframe.operators import filters as FL
from factorframe.operators import labels as L
from factorframe.operators import normalize as N
from factorframe.operators.order_windows import window_quantile
from factorframe.operators.ordering import average_ranks, group_positions, row_numbers
from factorframe.plans.registry import query
from factorframe.plans.testbed import with_ctes

KEY = {"code": "int", "date": "date"}


def _frames(*windows: int) -> str:
    named = ", ".join(f"w{n} AS (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in windows)
    return "WINDOW w AS (PARTITION BY code ORDER BY date)" + (f", {named}" if named else "")


def _strict(expression: str, counted: str, n: int) -> str:
    return f"CASE WHEN count({counted}) OVER w{n} >= {n} THEN {expression} END"


_RET = """r0 AS MATERIALIZED (SELECT *, close / lag(close) OVER w - 1 AS ret, close - lag(close) OVER w AS move
  FROM {src} WINDOW w AS (PARTITION BY code ORDER BY date))"""
WEEK_RET = with_ctes("wk", extra=_RET.format(src="wk"))


def rolling_query(name, digits, sql_expression, build, windows=(10,)):
    """Register one rolling statistic of weekly close / ret / volume."""

    @query(name, {**KEY, "value": digits}, WEEK_RET + f"SELECT code, date, {sql_expression} AS value FROM r0 {_frames(*windows)}")
    def run(t):
        return X.with_returns(t.week).select("code", "date", build().alias("value"))

    return run


def sql_skew(x: str, n: int) -> str:
    m, c = f"avg({x}) OVER w{n}", f"(count({x}) OVER w{n})"
    second = f"(avg({x} * {x}) OVER w{n} - ({m}) * ({m}))"
    third = f"(avg({x} * {x} * {x}) OVER w{n} - 3 * ({m}) * (avg({x} * {x}) OVER w{n}) + 2 * pow({m}, 3))"
    return f"CASE WHEN {c} >= {n} THEN {third} / pow({second}, 1.5) END"


rolling_query("w_ref", 9, "lag(close, 3) OVER w", lambda: R.ref("close", 3), ())
rolling_query("w_lead", 9, "lead(close, 2) OVER w", lambda: R.ref("close", -2), ())
rolling_query("w_mean", 6, _strict("avg(close) OVER w10", "close", 10), lambda: R.mean("close", 10))
rolling_query("w_std", 6, _strict("stddev_samp(ret) OVER w10", "ret", 10), lambda: R.std("ret", 10))
rolling_query("w_var", 6, _strict("var_samp(ret) OVER w10", "ret", 10), lambda: R.var("ret", 10))
rolling_query("w_max", 9, _strict("max(close) OVER w10", "close", 10), lambda: R.highest("close", 10))
rolling_query("w_min", 9, _strict("min(close) OVER w10", "close", 10), lambda: R.lowest("close", 10))
rolling_query("w_corr", 6, _strict("corr(volume, close) OVER w10", "close", 10), lambda: R.corr("volume", "close", 10))
rolling_query("w_cov", 4, _strict("covar_samp(volume, close) OVER w10", "close", 10), lambda: R.cov("volume", "close", 10))
rolling_query("w_skew", 5, sql_skew("ret", 10), lambda: R.skew("ret", 10))
rolling_query("w_kurt", 5, _strict("kurtosis_pop(ret) OVER w10", "ret", 10), lambda: R.kurt("ret", 10))
rolling_query(
    "w_quantile", 9, _strict("quantile_cont(close, 0.25) OVER w10", "close", 10), lambda: R.quantile("close", 10, 0.25)
)
rolling_query("pct_change", 8, "ret", lambda: R.pct_change("close", 1), ())
rolling_query("diff", 8, "move", lambda: R.diff("close", 1), ())
rolling_query("cummax", 9, "max(close) OVER (w ROWS UNBOUNDED PRECEDING)", lambda: R.cummax("close"), ())


@query(
    "w_slope",
    {**KEY, "value": 5},
    with_ctes("wk", extra="i AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) - 1 AS idx FROM wk)")
    + f"SELECT code, date, {_strict('regr_slope(close, idx) OVER w10', 'close', 10)} AS value FROM i {_frames(10)}",
)
def w_slope(t):
    return t.week.withColumn("idx", R.row_index()).select("code", "date", R.slope("close", "idx", 10).alias("value"))


@query(
    "expanding_median",
    {"date": "date", "value": 7},
    with_ctes("bench") + """SELECT date, CASE WHEN count(bench) OVER w >= 24 THEN median(bench) OVER w END AS value FROM bench
      WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""",
)
def expanding_median(t):
    series = t.benchmark.withColumn("series", F.lit("market"))
    return window_quantile(series, "bench", "value", min_periods=24, by="series").select("date", "value")


@query(
    "w_quantile_long",
    {**KEY, "value": 9},
    with_ctes("wk") + f"SELECT code, date, {_strict('quantile_cont(close, 0.8) OVER w60', 'close', 60)} AS value FROM wk {_frames(60)}",
)
def w_quantile_long(t):
    return window_quantile(t.week, "close", "value", 0.8, 60).select("code", "date", "value")


@query(
    "cumprod",
    {"date": "date", "value": 6},
    with_ctes("bench") + """SELECT date, exp(sum(ln(1 + bench)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) / 1e6 AS value FROM
      (SELECT date, bench / 100 AS bench FROM bench) b""",
)
def cumprod(t):
    series = t.benchmark.select("date", (F.col("bench") / 100).alias("bench"), F.lit("market").alias("series"))
    return series.select("date", (R.cumprod("bench", by="series") / 1e6).alias("value"))


@query(
    "cs_rank_avg",
    {**KEY, "rank": 2},
    with_ctes("wk") + """SELECT code, date, rank() OVER (PARTITION BY date ORDER BY volume)
      + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0 AS rank FROM wk""",
)
def cs_rank_avg(t):
    return average_ranks(t.week, ["date"], {"volume": "rank"})


@query(
    "cs_rank_split",
    {**KEY, "rank": 2},
    with_ctes("wk") + """SELECT code, date, rank() OVER (PARTITION BY date ORDER BY volume)
      + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0 AS rank FROM wk""",
)
def cs_rank_split(t):
    """The same ranks by the plan for large inputs: ties collapsed, groups cut into pieces of 20 distinct values."""
    return average_ranks(t.keep("week").week, ["date"], {"volume": "rank"}, rows_per_piece=20)


@query(
    "group_positions",
    {"volume": 4, "copies": "int", "before": "int", "total": "int"},
    with_ctes("wk") + """SELECT volume, copies, sum(copies) OVER (ORDER BY volume) - copies AS before, sum(copies) OVER () AS total
      FROM (SELECT volume, count(*) AS copies FROM wk GROUP BY volume) q""",
)
def positions(t):
    return group_positions(t.week, [], "volume", rows_per_piece=20)


_GRADE_EDGES = """e AS (SELECT date, quantile_cont(volume, 0.2) a, quantile_cont(volume, 0.4) b, quantile_cont(volume, 0.6) c,
  quantile_cont(volume, 0.8) d, min(volume) AS lo, count(*) AS n FROM wk GROUP BY date)"""


@query(
    "cs_ntile",
    {**KEY, "grade": "int"},
    with_ctes("wk", extra=_GRADE_EDGES) + """SELECT code, date, CASE WHEN n < 5 THEN 2 ELSE
        (CASE WHEN a > lo AND volume > a THEN 1 ELSE 0 END) + (CASE WHEN b > a AND volume > b THEN 1 ELSE 0 END)
        + (CASE WHEN c > b AND volume > c THEN 1 ELSE 0 END) + (CASE WHEN d > c AND volume > d THEN 1 ELSE 0 END) END AS grade
      FROM wk JOIN e USING (date)""",
)
def cs_ntile(t):
    return L.quantile_grades(t.week, ["date"], "volume")


@query(
    "flat_runs",
    {"code": "int", "volume": 4, "start_date": "date", "end_date": "date", "length": "int"},
    with_ctes("panel_day", extra="""m AS (SELECT code, date, volume, CASE WHEN lag(volume) OVER w = volume THEN 0 ELSE 1 END AS new
      FROM panel_day WINDOW w AS (PARTITION BY code ORDER BY date)),
      g AS (SELECT *, sum(new) OVER (PARTITION BY code ORDER BY date) AS run FROM m)""")
    + """SELECT code, min(volume) AS volume, min(date) AS start_date, max(date) AS end_date, count(*) AS length FROM g
         GROUP BY code, run HAVING count(*) >= 2""",
)
def flat_runs(t):
    return FL.flat_runs(t.day, "volume", ["code"], min_length=2)


@query(
    "cumulative_share",
    {"industry": "str", "amount": 3, "share": 7, "place": "int"},
    with_ctes("wk", "industry", extra="a AS (SELECT industry, sum(amount) AS amount FROM wk JOIN industry USING (code) GROUP BY industry)")
    + """SELECT industry, amount, sum(amount) OVER (ORDER BY amount DESC, industry) / sum(amount) OVER () AS share,
                row_number() OVER (ORDER BY amount DESC, industry) AS place FROM a""",
)
def cumulative_share(t):
    from factorframe.operators.modelling import cumulative_share as share

    totals = t.week.join(t.industry, "code").groupBy("industry").agg(F.sum("amount").alias("amount"))
    return share(totals, "amount", "industry")


@query(
    "row_rank",
    {**KEY, "rank": "int"},
    with_ctes("score") + "SELECT code, date, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS rank FROM score",
)
def row_rank(t):
    return row_numbers(t.score, ["date"], [-F.col("score"), F.col("code")])


@query(
    "autocorr_lag",
    {"code": "int", "lag": "int", "autocorrelation": 6},
    WEEK_RET + """, s AS (SELECT code, ret, row_number() OVER (PARTITION BY code ORDER BY date) AS i,
        count(*) OVER (PARTITION BY code) AS n FROM r0 WHERE ret IS NOT NULL)
      SELECT a.code, b.i - a.i AS lag, corr(a.ret, b.ret) AS autocorrelation FROM s a JOIN s b
        ON a.code = b.code AND b.i - a.i BETWEEN 1 AND 8 WHERE a.n >= 16 GROUP BY a.code, b.i - a.i""",
)
def autocorr_lag(t):
    from factorframe.operators.ic import autocorrelation

    return autocorrelation(X.with_returns(t.week), "ret", 8, ["code"])


# ---- factor sets -----------------------------------------------------------------------------------------------------


def factor_query(name, digits, columns, windows=(), source="wk", beta=False):
    """Register factors given as {column: (sql, Column builder)}."""
    sql = ", ".join(f"{text} AS {column}" for column, (text, _) in columns.items())
    base = with_ctes(source, extra=_RET.format(src=source))
    table = "r0"
    if beta:
        base += """, mk AS (SELECT date, avg(ret) AS market FROM r0 GROUP BY date),
            rb AS MATERIALIZED (SELECT r0.*, market FROM r0 JOIN mk USING (date))"""
        table = "rb"

    @query(name, {**KEY, **{c: digits for c in columns}}, base + f" SELECT code, date, {sql} FROM {table} {_frames(*windows)}")
    def run(t):
        rows = X.with_returns(t.week if source == "wk" else t.day)
        if beta:
            rows = rows.join(X.date_sized(X.market_return(rows)), "date")
        return rows.select("code", "date", *[build().alias(c) for c, (_, build) in columns.items()])

    return run


SQL_KBAR = {
    "kmid": "(close - open) / open", "klen": "(high - low) / open", "kup": "(high - greatest(open, close)) / open",
    "klow": "(least(open, close) - low) / open",
}
SQL_RSI = f"""CASE WHEN count(move) OVER w14 >= 14 THEN CASE WHEN sum(greatest(-move, 0)) OVER w14 > 0 THEN
  100 - 100 / (1 + (avg(greatest(move, 0)) OVER w14) / (avg(greatest(-move, 0)) OVER w14)) ELSE 100 END END"""


def sql_factors(n: int) -> dict[str, str]:
    return {
        f"roc_{n}": f"close / lag(close, {n}) OVER w - 1",
        f"ma_{n}": _strict(f"avg(close) OVER w{n} / close", "close", n),
        f"std_{n}": _strict(f"stddev_samp(ret) OVER w{n}", "ret", n),
        f"high_{n}": _strict(f"max(close) OVER w{n} / close - 1", "close", n),
        f"low_{n}": _strict(f"min(close) OVER w{n} / close - 1", "close", n),
        f"vroc_{n}": f"volume / lag(volume, {n}) OVER w - 1",
        f"vma_{n}": _strict(f"avg(volume) OVER w{n}", "volume", n),
        f"vstd_{n}": _strict(f"stddev_samp(volume) OVER w{n}", "volume", n),
        f"corr_{n}": _strict(f"corr(volume, close) OVER w{n}", "close", n),
        f"skew_{n}": sql_skew("ret", n),
        f"kurt_{n}": _strict(f"kurtosis_pop(ret) OVER w{n}", "ret", n),
        f"vwap_{n}": _strict(f"(sum(amount) OVER w{n}) / (sum(volume) OVER w{n}) / close - 1", "close", n),
        f"beta_{n}": _strict(f"covar_samp(ret, market) OVER w{n} / var_samp(market) OVER w{n}", "ret", n),
    }


def _pick(prefix: str, windows) -> dict:
    build = {
        "roc": X.roc, "ma": X.ma_ratio, "std": X.volatility, "high": X.dist_high, "low": X.dist_low, "vroc": X.volume_roc,
        "vma": X.volume_mean, "vstd": X.volume_std, "corr": X.corr_pv, "vwap": X.vwap_dev, "beta": X.beta,
        "skew": lambda n: R.skew("ret", n), "kurt": lambda n: R.kurt("ret", n),
    }[prefix]
    return {f"{prefix}_{n}": (sql_factors(n)[f"{prefix}_{n}"], lambda n=n: build(n)) for n in windows}


factor_query("kbar", 7, {c: (text, lambda c=c: X.kbar()[c]) for c, text in SQL_KBAR.items()})
factor_query("roc", 7, _pick("roc", (5, 10, 20)))
factor_query(
    "ma_ratio",
    6,
    {**_pick("ma", (5, 10)), "ma5_ma60": (
        "CASE WHEN count(close) OVER w60 >= 60 THEN avg(close) OVER w5 / avg(close) OVER w60 END", lambda: X.ma_cross(5, 60))},
    (5, 10, 60),
)
factor_query("volatility", 7, _pick("std", (5, 20)), (5, 20))
factor_query("dist_high", 7, _pick("high", (5, 20)), (5, 20))
factor_query("dist_low", 7, _pick("low", (5, 20)), (5, 20))
factor_query("beta", 6, _pick("beta", (12, 20)), (12, 20), beta=True)
factor_query("vroc", 7, _pick("vroc", (5, 10)))
factor_query("vma", 5, _pick("vma", (5, 20)), (5, 20))
factor_query("vstd", 5, _pick("vstd", (5, 20)), (5, 20))
factor_query("corr_pv", 6, _pick("corr", (20,)), (20,))
factor_query("illiquidity", 8, {"illiq": ("abs(ret) / nullif(volume, 0)", X.illiquidity)})
factor_query("ret_skew", 5, _pick("skew", (20,)), (20,))
factor_query("ret_kurt", 5, _pick("kurt", (20,)), (20,))
factor_query("rsi", 5, {"rsi_14": (SQL_RSI, X.rsi)}, (14,))
factor_query("vwap_dev", 6, _pick("vwap", (5, 20)), (5, 20))
factor_query("momentum_12_1", 7, {"mom": ("lag(close, 4) OVER w / lag(close, 26) OVER w - 1", lambda: X.momentum_12_1(4, 26))})


def _feature_sql(windows) -> tuple[dict, str]:
    columns = {**SQL_KBAR, "illiq": "abs(ret) / nullif(volume, 0)", "rsi_14": SQL_RSI}
    for n in windows:
        columns |= sql_factors(n)
    sql = (
        with_ctes("panel_day", extra=_RET.format(src="panel_day"))
        + """, mk AS (SELECT date, avg(ret) AS market FROM r0 GROUP BY date),
        rb AS MATERIALIZED (SELECT r0.*, market FROM r0 JOIN mk USING (date))"""
        + " SELECT code, date, " + ", ".join(f"{text} AS {c}" for c, text in columns.items())
        + f" FROM rb {_frames(14, *windows)}"
    )
    digits = {c: 4 if c.split("_")[0] in ("skew", "kurt", "vma", "vstd", "rsi", "high", "vwap", "ma", "beta") else 6 for c in columns}
    return {**KEY, **digits}, sql


_SHORT, _LONG = _feature_sql(X.SHORT_WINDOWS), _feature_sql(X.LONG_WINDOWS)


@query("features_short", *_SHORT)
def features_short(t):
    return X.features(t.keep("day").day, X.SHORT_WINDOWS)


@query("features_long", *_LONG)
def features_long(t):
    return X.features(t.keep("day").day, X.LONG_WINDOWS)


# ---- labels and normalisation ----------------------------------------------------------------------------------------

LABEL = {**KEY, "label": 7}


@query("label_ret", LABEL, with_ctes("wk") + """SELECT code, date, lead(close, 4) OVER w / lead(close, 1) OVER w - 1 AS label FROM wk
  WINDOW w AS (PARTITION BY code ORDER BY date)""")
def label_ret(t):
    return L.make_label(t.week, "ret_4d")


@query("label_xs_ret", LABEL, with_ctes("label", extra="m AS (SELECT date, median(label) AS med FROM label GROUP BY date)")
       + "SELECT code, date, label - med AS label FROM wk LEFT JOIN label USING (code, date) LEFT JOIN m USING (date)")
def label_xs_ret(t):
    return L.make_label(t.week, "xs_ret_4d")


@query("label_xs_ret_zscore", LABEL, with_ctes("label", extra="""z AS (SELECT code, date, (label - avg(label) OVER p) / nullif(stddev_samp(label) OVER p, 0) AS z
    FROM label WINDOW p AS (PARTITION BY date)), m AS (SELECT date, median(z) AS med FROM z GROUP BY date)""")
       + "SELECT code, date, z - med AS label FROM wk LEFT JOIN z USING (code, date) LEFT JOIN m USING (date)")
def label_xs_ret_zscore(t):
    return L.make_label(t.week, "xs_ret_4d", zscore_first=True)


_INDEX = """ix AS (SELECT date, exp(sum(ln(1 + bench / 100)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS close FROM bench)"""


def index_close(t):
    """Benchmark level: running product of a hundredth of the market return, which keeps the level in range."""
    series = t.benchmark.select("date", (F.col("bench") / 100).alias("r"), F.lit("market").alias("series"))
    return series.select("date", R.cumprod("r", by="series").alias("close"))


@query("label_alpha", {**KEY, "label": 6}, with_ctes("label", "bench", extra=_INDEX + """,
  ib AS (SELECT date, lead(close, 4) OVER w / lead(close, 1) OVER w - 1 AS b FROM ix WINDOW w AS (ORDER BY date))""")
       + "SELECT code, date, label - coalesce(b, 0) AS label FROM wk LEFT JOIN label USING (code, date) LEFT JOIN ib USING (date)")
def label_alpha(t):
    return L.make_label(t.week, "alpha_4d", index_close(t))


@query("label_updown", {**KEY, "label": "int"}, with_ctes("label")
       + "SELECT code, date, CASE WHEN label > 0 THEN 1 WHEN label IS NOT NULL THEN 0 END AS label FROM wk LEFT JOIN label USING (code, date)")
def label_updown(t):
    return L.make_label(t.week, "up_down_4d")


@query(
    "label_grade",
    {**KEY, "grade": "int"},
    with_ctes("sl", extra="""e AS (SELECT date, quantile_cont(label, 0.2) a, quantile_cont(label, 0.4) b, quantile_cont(label, 0.6) c,
      quantile_cont(label, 0.8) d, count(*) AS n FROM sl GROUP BY date)""")
    + """SELECT code, date, CASE WHEN n < 5 THEN 2 WHEN label <= a THEN 0 WHEN label <= b THEN 1 WHEN label <= c THEN 2
                                 WHEN label <= d THEN 3 ELSE 4 END AS grade FROM sl JOIN e USING (date)""",
)
def label_grade(t):
    return L.quantile_grades(t.scored, ["date"], "label")


@query("group_sizes", {"date": "date", "n": "int"}, with_ctes("sl") + "SELECT date, count(*) AS n FROM sl GROUP BY date")
def group_sizes(t):
    return t.scored.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cs_zscore",
    {**KEY, "score": 6},
    with_ctes("score", extra="s AS (SELECT date, avg(score) m, stddev_samp(score) d FROM score GROUP BY date)")
    + "SELECT code, date, CASE WHEN d > 0 THEN (score - m) / d END AS score FROM score JOIN s USING (date)",
)
def cs_zscore(t):
    return N.cs_zscore(t.score, ["score"])


@query(
    "robust_zscore_fit",
    {**KEY, "close": 6, "volume": 6},
    with_ctes("wk", extra="""m AS (SELECT median(close) mc, median(volume) mv FROM wk WHERE date < DATE '1998-01-01'),
      d AS (SELECT median(abs(close - mc)) dc, median(abs(volume - mv)) dv FROM wk, m WHERE date < DATE '1998-01-01')""")
    + """SELECT code, date, greatest(-3, least(3, (close - mc) / (dc * 1.4826))) AS close,
                greatest(-3, least(3, (volume - mv) / (dv * 1.4826))) AS volume FROM wk, m, d""",
)
def robust_zscore_fit(t):
    fit = F.col("date") < F.lit("1998-01-01").cast("date")
    return N.robust_zscore_fit(t.week, ["close", "volume"], fit, clip=3.0)


@query(
    "zscore_fit",
    {**KEY, "close": 6, "volume": 6},
    with_ctes("wk", extra="""m AS (SELECT avg(close) mc, stddev_samp(close) dc, avg(volume) mv, stddev_samp(volume) dv FROM wk
      WHERE date < DATE '1998-01-01')""")
    + "SELECT code, date, (close - mc) / dc AS close, (volume - mv) / dv AS volume FROM wk, m",
)
def zscore_fit(t):
    return N.zscore_fit(t.week, ["close", "volume"], F.col("date") < F.lit("1998-01-01").cast("date"))


@query("drop_null_label", LABEL, with_ctes("label") + "SELECT code, date, label FROM label")
def drop_null_label(t):
    return N.drop_null_label(L.label_returns(t.week, 4))


@query("fill_null", LABEL, with_ctes("label") + "SELECT code, date, coalesce(label, 0) AS label FROM wk LEFT JOIN label USING (code, date)")
def fill_null(t):
    return N.fill_null(L.label_returns(t.week, 4), {"label": 0.0})


@query(
    "neutralize",
    {**KEY, "residual": 6},
    with_ctes("score", "industry", extra="""b AS (SELECT s.code, s.date, score, industry, ln(w.amount) AS size
        FROM score s JOIN wk w ON s.code = w.code AND s.date = w.date JOIN industry i ON i.code = s.code),
      d AS (SELECT code, date, score - avg(score) OVER p AS v, size - avg(size) OVER p AS s FROM b
            WINDOW p AS (PARTITION BY date, industry)),
      k AS (SELECT date, CASE WHEN sum(s * s) > 1e-12 THEN sum(v * s) / sum(s * s) ELSE 0 END AS beta FROM d GROUP BY date)""")
    + "SELECT code, date, v - beta * s AS residual FROM d JOIN k USING (date)",
)
def neutralize(t):
    rows = t.keep("week").week.select(
        "code", "date", (-R.pct_change("close", 4)).alias("score"), F.log("amount").alias("size")
    ).join(t.industry, "code")
    return N.neutralize(rows, "score", "industry", "size")
