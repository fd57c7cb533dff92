"""Selection, holdings, performance, risk and attribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorframe.functions import rolling as R
from factorframe.operators import aggregates as A
from factorframe.operators import picks as K
from factorframe.operators import portfolio as P
from factorframe.operators import risk as Q
from factorframe.plans.panel_queries import _BOARD
from factorframe.plans.registry import query
from factorframe.plans.sql import sql_solved, sql_system, sql_newey_west
from factorframe.session import materialize
from factorframe.plans.testbed import CTES, with_ctes

# ---- selection -------------------------------------------------------------------------------------------------------

CTES["tgt"] = (("score",), """
    SELECT t.date, code, score, rank, idx FROM
      (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS rank FROM score) t
      JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM score) d) i ON i.date = t.date
    WHERE rank <= 10""")
CTES["tgt30"] = (("score",), """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS rank FROM score) t
    WHERE rank <= 30""")
CTES["trades"] = (("tgt",), """
    SELECT date, code, 'BUY' AS action FROM tgt t
    WHERE NOT EXISTS (SELECT 1 FROM tgt p WHERE p.code = t.code AND p.idx = t.idx - 1)
    UNION ALL
    SELECT i.date, p.code, 'SELL' FROM tgt p JOIN (SELECT DISTINCT date, idx FROM tgt) i ON i.idx = p.idx + 1
    WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.code = p.code AND t.idx = p.idx + 1)""")
CTES["exe"] = (("wk", "names"), f"""
    SELECT code, date, nr AS next_return, coalesce(chg >= th, false) OR c1 IS NULL AS no_buy,
           coalesce(chg <= -th, false) OR c1 IS NULL AS no_sell
    FROM (SELECT code, date, lead(open, 2) OVER w / lead(open, 1) OVER w - 1 AS nr, lead(close, 1) OVER w AS c1,
                 lead(close, 1) OVER w / close - 1 AS chg FROM wk WINDOW w AS (PARTITION BY code ORDER BY date)) x
    JOIN (SELECT code, CASE {_BOARD} WHEN 'main' THEN 0.099 WHEN 'bj' THEN 0.299 ELSE 0.199 END AS th FROM names) b USING (code)""")
# returns are scaled to a hundredth: the derived prices jump too far to compound
CTES["rep0"] = (("trades", "exe", "bench"), """
    SELECT date, coalesce(avg(CASE WHEN held THEN next_return END), 0) / 100 AS "return", count(CASE WHEN held THEN 1 END) AS n_held,
           (count(CASE WHEN bought THEN 1 END) + count(CASE WHEN sold THEN 1 END)) / CAST(greatest(sum(t), 1) AS DOUBLE) / 2 AS turnover,
           count(CASE WHEN bought THEN 1 END) / CAST(greatest(sum(t), 1) AS DOUBLE) * 0.0005
             + count(CASE WHEN sold THEN 1 END) / CAST(greatest(sum(t), 1) AS DOUBLE) * 0.0015 AS cost
    FROM (SELECT m.date, next_return, t, b = 1 AND NOT coalesce(no_buy, true) AS bought, s = 1 AND NOT coalesce(no_sell, false) AS sold,
                 (b = 0 AND s = 0) OR (b = 1 AND NOT coalesce(no_buy, true)) OR (s = 1 AND coalesce(no_sell, false)) AS held
          FROM (SELECT date, code, max(b) AS b, max(s) AS s, max(t) AS t FROM
                  (SELECT date, code, 0 AS b, 0 AS s, 1 AS t FROM tgt
                   UNION ALL SELECT date, code, CASE WHEN action = 'BUY' THEN 1 ELSE 0 END, CASE WHEN action = 'SELL' THEN 1 ELSE 0 END, 0
                   FROM trades) u GROUP BY date, code) m LEFT JOIN exe ON exe.code = m.code AND exe.date = m.date) f
    GROUP BY date""")
_least = "* greatest({rate} / CAST(greatest(sum(t), 1) AS DOUBLE), 5.0 / 1e4)"
_parts = CTES["rep0"][1].replace("/ CAST(greatest(sum(t), 1) AS DOUBLE) * 0.0005", _least.format(rate="0.0005")).replace(
    "/ CAST(greatest(sum(t), 1) AS DOUBLE) * 0.0015", _least.format(rate="0.0015"))
CTES["rep_min_fee"] = (CTES["rep0"][0], _parts)
CTES["rep"] = (("rep0", "bench"), """SELECT r.*, coalesce(b.bench, 0) / 100 AS bench FROM rep0 r LEFT JOIN bench b USING (date)""")


def targets(t, k: int = 10):
    return K.first_k(t.score, ["date"], [F.desc("score"), F.col("code")], k)


def report(t, held=None):
    """held: the targets, where the caller has them."""
    t.keep("week")
    rows = P.portfolio_returns(targets(t) if held is None else held, P.execution_view(t.week, t.names.select("code", "listed")), t.benchmark)
    return materialize(rows.withColumns({"return": F.col("return") / 100, "bench": F.col("bench") / 100}))


PICK = {"date": "date", "code": "int", "score": 7, "rank": "int", "strength": "str"}
_STRENGTH = """SELECT date, code, score, rank, CASE WHEN score >= s80 THEN 'strong' WHEN score >= s50 THEN 'medium' WHEN score > 0 THEN 'weak'
  ELSE 'negative' END AS strength FROM tgt JOIN (SELECT date, quantile_cont(score, 0.8) AS s80, quantile_cont(score, 0.5) AS s50
  FROM tgt GROUP BY date) q USING (date)"""


@query("top_k_picks", PICK, with_ctes("tgt") + f"SELECT * FROM ({_STRENGTH}) z WHERE date = (SELECT max(date) FROM score)")
def top_k_picks(t):
    return K.top_k(t.score, 10, "latest")


@query("top_k_all_dates", PICK, with_ctes("tgt") + _STRENGTH)
def top_k_all_dates(t):
    return K.top_k(t.score, 10)


_CAPPED = """capped AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY date, industry ORDER BY score DESC, code) AS ir FROM
    (SELECT s.*, coalesce(industry, 'Other') AS industry FROM {src} s LEFT JOIN industry USING (code)) a) b WHERE ir <= 2)"""


@query(
    "industry_cap_select",
    {"date": "date", "code": "int", "industry": "str", "rank": "int"},
    with_ctes("score", "industry", extra=_CAPPED.format(src="score")) + "SELECT date, code, industry, rank FROM capped WHERE rank <= 10",
)
def industry_cap_select(t):
    return K.industry_cap(t.score, t.industry, 10)


_ADV = """adv AS (SELECT code, arg_max(CASE WHEN c >= 60 THEN m END, date) AS adv0, max(date) AS last FROM
    (SELECT code, date, avg(amount) OVER w AS m, count(amount) OVER w AS c FROM wk
     WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) q GROUP BY code)"""


@query(
    "industry_liquidity_select",
    {"date": "date", "code": "int", "industry": "str", "rank": "int", "weight": 6},
    with_ctes("score", "industry", extra=_ADV + ", liq AS (SELECT s.* FROM score s LEFT JOIN adv USING (code) WHERE NOT coalesce(adv0 > 0 AND 5e3 / adv0 > 0.05, false)), "
              + _CAPPED.format(src="liq")) + "SELECT date, code, industry, rank, 0.1 AS weight FROM capped WHERE rank <= 10",
)
def industry_liquidity_select(t):
    return K.industry_liquidity(t.score, t.industry, Q.average_amount(t.week), 10, account=5e4)


@query("rebalance_trades", {"date": "date", "code": "int", "action": "str"}, with_ctes("trades") + "SELECT * FROM trades")
def rebalance_trades(t):
    return K.rebalance_trades(targets(t))


# The walk over dates as a recursive query: the held list of one date gives the next
_WALK = """td AS MATERIALIZED (SELECT idx, max(date) AS date, list(code ORDER BY rank) AS top FROM tgt GROUP BY idx),
sc AS MATERIALIZED (SELECT i.idx, map_from_entries(list((s.code, s.score))) AS m FROM score s
  JOIN (SELECT DISTINCT date, idx FROM tgt) i USING (date) GROUP BY i.idx),
step AS MATERIALIZED (SELECT td.idx, td.date, top, m FROM td JOIN sc USING (idx)),
walk AS (
  SELECT idx, date, top AS held, [] :: BIGINT[] AS sells, top AS buys FROM step WHERE idx = 0
  UNION ALL
  SELECT idx, date, list_concat(list_filter(held, lambda c: NOT list_contains(sells, c)), buys) AS held, sells, buys FROM (
    SELECT idx, date, held, sells, list_slice(list_filter(top, lambda c: NOT list_contains(held, c)), 1, len(sells)) AS buys FROM (
      SELECT s.idx, s.date, s.top, w.held,
             list_transform(list_slice(list_sort(list_transform(list_filter(w.held, lambda c: NOT list_contains(s.top, c)),
               lambda c: {'k': coalesce(s.m[c], -999.0), 'c': c})), 1, 2), lambda x: x.c) AS sells
      FROM walk w JOIN step s ON s.idx = w.idx + 1) a) b)"""


@query(
    "dropout_holdings",
    {"strategy": "str", "date": "date", "code": "int", "action": "str"},
    with_ctes("tgt", extra=_WALK).replace("WITH ", "WITH RECURSIVE ", 1) + """
      SELECT 'k10d2' AS strategy, date, unnest(held) AS code, 'HOLD' AS action FROM walk
      UNION ALL SELECT 'k10d2', date, unnest(sells), 'SELL' FROM walk
      UNION ALL SELECT 'k10d2', date, unnest(buys), 'BUY' FROM walk""",
)
def dropout_holdings(t):
    return K.dropout_holdings(t.score, [("k10d2", 10, 2)])


@query("dropout_grid", {"strategy": "str", "n_dates": "int", "n_buys": "int", "n_sells": "int", "max_held": "int"})
def dropout_grid(t):
    """Several (k, n_drop) cells walked in parallel."""
    rows = K.dropout_holdings(t.score, [(f"k{k}d{d}", k, d) for k in (5, 10, 20) for d in (1, 2, 5)])
    daily = rows.groupBy("strategy", "date").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("BUY", "SELL", "HOLD")])
    return daily.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_dates"), F.sum("BUY").alias("n_buys"), F.sum("SELL").alias("n_sells"), F.max("HOLD").alias("max_held")
    )


_VALUES = """v AS (SELECT date, 1e6 * exp(sum(ln(1 + "return")) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS pv FROM
      (SELECT date, "return" / 10 AS "return" FROM rep) r)"""


@query(
    "position_values",
    {"date": "date", "code": "int", "n_hold": "int", "weight": 7, "position_value": 0},
    with_ctes("tgt", "rep", extra=_VALUES)
    + """SELECT date, code, count(*) OVER (PARTITION BY date) AS n_hold, 1.0 / count(*) OVER (PARTITION BY date) AS weight,
                coalesce(pv, 1e6) / count(*) OVER (PARTITION BY date) AS position_value FROM tgt LEFT JOIN v USING (date)""",
)
def position_values(t, held=None):
    returns = report(t, held).select("date", (F.col("return") / 10).alias("return"))
    return K.position_values(targets(t) if held is None else held, returns, 1e6)


@query(
    "trade_summary",
    {"action": "str", "n_trades": "int", "total_amount": 4},
    with_ctes("trades", "tgt", "rep", extra=_VALUES + """, ps AS (SELECT tgt.date, idx, code, coalesce(pv, 1e6) / count(*) OVER (PARTITION BY tgt.date) AS amount
      FROM tgt LEFT JOIN v USING (date)), ti AS (SELECT tr.*, d.idx - (action = 'SELL')::INT AS at FROM trades tr JOIN (SELECT DISTINCT date, idx FROM tgt) d USING (date))""")
    + "SELECT action, count(*) AS n_trades, sum(amount) AS total_amount FROM ti LEFT JOIN ps ON ps.idx = ti.at AND ps.code = ti.code GROUP BY action",
)
def trade_summary(t):
    t.keep("week")  # before anything reads it: trades, values and the report all start there
    held = materialize(targets(t))  # k rows per date, read by ten branches
    return K.trade_summary(K.trade_amounts(K.rebalance_trades(held), position_values(t, held)))


@query(
    "cap_buys",
    {"date": "date", "code": "int", "action": "str"},
    with_ctes("trades", "score", "industry", extra="""cb AS (SELECT tr.*, row_number() OVER (PARTITION BY tr.date, coalesce(industry, 'Other') ORDER BY score DESC NULLS LAST, tr.code) AS r
      FROM trades tr LEFT JOIN score s ON s.date = tr.date AND s.code = tr.code LEFT JOIN industry i ON i.code = tr.code WHERE action = 'BUY')""")
    + "SELECT date, code, action FROM cb WHERE r <= 1 UNION ALL SELECT date, code, action FROM trades WHERE action <> 'BUY'",
)
def cap_buys(t):
    return K.cap_buys(K.rebalance_trades(targets(t)), t.score, t.industry, 10, 0.1)


@query(
    "portfolio_returns",
    {"date": "date", "return": 7, "bench": 7, "turnover": 6, "cost": 8, "n_held": "int"},
    with_ctes("rep") + 'SELECT date, "return", bench, turnover, cost, n_held FROM rep',
)
def portfolio_returns(t):
    return report(t)


_FWD = """fwd AS MATERIALIZED (SELECT tgt.date, tgt.code, rank, rec_price, (p5 - rec_price) / rec_price AS ret_5d,
    (p10 - rec_price) / rec_price AS ret_10d, (p20 - rec_price) / rec_price AS ret_20d
  FROM tgt JOIN (SELECT code, date, lead(open, 1) OVER w AS rec_price, lead(open, 6) OVER w AS p5, lead(open, 11) OVER w AS p10,
                        lead(open, 21) OVER w AS p20 FROM wk WINDOW w AS (PARTITION BY code ORDER BY date)) l USING (code, date)
  WHERE rec_price IS NOT NULL)"""


def forward(t, k: int = 10):
    return P.pick_forward_returns(targets(t, k).select("date", "code", "rank"), t.week)


@query("portfolio_min_fee", {"date": "date", "turnover": 7, "cost": 8}, with_ctes("rep_min_fee") + "SELECT date, turnover, cost FROM rep_min_fee")
def portfolio_min_fee(t):
    """Every order costs at least 5 of an account of 10 000."""
    return P.portfolio_returns(targets(t), P.execution_view(t.week, t.names.select("code", "listed")), min_cost=5.0, account=1e4)


@query(
    "pick_forward_returns",
    {"date": "date", "code": "int", "rank": "int", "rec_price": 9, "ret_5d": 7, "ret_10d": 7, "ret_20d": 7},
    with_ctes("tgt", extra=_FWD) + "SELECT * FROM fwd",
)
def pick_forward_returns(t):
    return forward(t)


HIT = {"hit_rate": 7, "avg_return": 6, "median_return": 6, "max_return": 6, "min_return": 6, "n": "int", "hits": "int"}
_HIT = """avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(ret) AS avg_return, median(ret) AS median_return, max(ret) AS max_return,
  min(ret) AS min_return, count(*) AS n, count(CASE WHEN ret > 0 THEN 1 END) AS hits"""
_H3 = {"ret_5d": "5d", "ret_10d": "10d", "ret_20d": "20d"}


@query(
    "hit_rate",
    {"horizon": "str", **HIT},
    with_ctes("tgt", extra=_FWD) + f"""SELECT horizon, {_HIT} FROM (SELECT '5d' AS horizon, ret_5d AS ret FROM fwd UNION ALL
      SELECT '10d', ret_10d FROM fwd UNION ALL SELECT '20d', ret_20d FROM fwd) q WHERE ret IS NOT NULL GROUP BY horizon""",
)
def hit_rate(t):
    return A.hit_rate(forward(t), _H3)


@query(
    "validation_report",
    {"scope": "str", "bucket": "str", **HIT},
    with_ctes("tgt30", "industry", extra=_FWD.replace("tgt", "tgt30")) + f"""SELECT scope, bucket, {_HIT} FROM (
      SELECT 'horizon' AS scope, '5d' AS bucket, ret_5d AS ret FROM fwd UNION ALL SELECT 'horizon', '10d', ret_10d FROM fwd
      UNION ALL SELECT 'horizon', '20d', ret_20d FROM fwd
      UNION ALL SELECT 'rank', CASE WHEN rank <= 10 THEN 'rank_1_10' WHEN rank <= 20 THEN 'rank_11_20' WHEN rank <= 30 THEN 'rank_21_30' END, ret_5d FROM fwd
      UNION ALL SELECT 'industry', industry, ret_5d FROM fwd JOIN industry USING (code)) q WHERE ret IS NOT NULL AND bucket IS NOT NULL GROUP BY scope, bucket""",
)
def validation_report(t):
    return A.validation_report(forward(t, 30).join(t.industry, "code", "left"), _H3, "ret_5d")


@query(
    "excess_return",
    {"excess_return": 6, "excess_median": 6, "excess_positive_rate": 7, "n": "int"},
    with_ctes("tgt", "bench", extra=_FWD) + """SELECT avg(x) AS excess_return, median(x) AS excess_median,
      avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS excess_positive_rate, count(*) AS n
      FROM (SELECT ret_5d - coalesce(bench, 0) AS x FROM fwd LEFT JOIN bench USING (date) WHERE ret_5d IS NOT NULL) q""",
)
def excess_return(t):
    return A.excess_return(forward(t), t.benchmark, "ret_5d")


# ---- performance -----------------------------------------------------------------------------------------------------

_SMALL = """sm AS (SELECT date, "return" / 10 AS "return", bench / 10 AS bench, turnover FROM rep),
wealth AS MATERIALIZED (SELECT date, product(1 + "return") OVER w AS cum, product(1 + bench) OVER w AS cum_bench FROM sm
  WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
dd AS MATERIALIZED (SELECT date, cum, cum / max(cum) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM wealth)"""
_PERF = with_ctes("rep", extra=_SMALL)


def small_report(t):
    return report(t).withColumns({"return": F.col("return") / 10, "bench": F.col("bench") / 10})


@query("cumulative_return", {"date": "date", "cum_return": 5, "cum_bench": 5}, _PERF + "SELECT date, cum AS cum_return, cum_bench FROM wealth")
def cumulative_return(t):
    return P.cumulative_return(small_report(t))


@query("drawdown", {"date": "date", "cum": 5, "drawdown": 7}, _PERF + "SELECT * FROM dd")
def drawdown(t):
    return P.drawdown(small_report(t))


@query("max_drawdown", {"max_drawdown": 7}, _PERF + "SELECT min(drawdown) AS max_drawdown FROM dd")
def max_drawdown(t):
    return P.max_drawdown(small_report(t))


@query(
    "rolling_sharpe",
    {"date": "date", "sharpe": 6},
    _PERF + """SELECT date, sharpe FROM (SELECT date, CASE WHEN count(*) OVER w >= 60 THEN avg("return") OVER w / stddev_samp("return") OVER w * sqrt(252)
      END AS sharpe FROM sm WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) q WHERE sharpe IS NOT NULL""",
)
def rolling_sharpe(t):
    return P.rolling_sharpe(small_report(t))


@query(
    "perf_summary",
    {"annual_return": 6, "annual_vol": 6, "sharpe": 5, "max_drawdown": 6, "calmar": 3, "win_rate": 7, "annual_excess": 6,
     "information_ratio": 5},
    _PERF + """SELECT avg("return") * 252 AS annual_return, stddev_samp("return") * sqrt(252) AS annual_vol,
      avg("return") / stddev_samp("return") * sqrt(252) AS sharpe, (SELECT min(drawdown) FROM dd) AS max_drawdown,
      avg("return") * 252 / nullif(abs((SELECT min(drawdown) FROM dd)), 0) AS calmar, avg(CASE WHEN "return" > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
      avg("return" - bench) * 252 AS annual_excess, avg("return" - bench) / stddev_samp("return" - bench) * sqrt(252) AS information_ratio FROM sm""",
)
def perf_summary(t):
    return P.perf_summary(small_report(t))


@query(
    "cost_drag",
    {"annual_turnover": 5, "annual_cost": 7, "excess_before_cost": 6, "excess_after_cost": 6, "negative_after_cost": "bool"},
    _PERF + """SELECT *, excess_before_cost - annual_cost AS excess_after_cost, excess_before_cost - annual_cost < 0 AS negative_after_cost FROM (
      SELECT avg(turnover) * 252 AS annual_turnover, avg(turnover) * 252 * 0.002 AS annual_cost,
             (avg("return") - avg(bench)) * 252 AS excess_before_cost FROM sm) q""",
)
def cost_drag(t):
    return P.cost_drag(small_report(t))


@query(
    "describe_series",
    {"series": "str", "daily_mean": 7, "annual_mean": 5, "sharpe": 5},
    _PERF + " UNION ALL ".join(
        f"""SELECT '{c}' AS series, avg("{c}") AS daily_mean, avg("{c}") * 252 AS annual_mean,
            avg("{c}") / nullif(stddev_samp("{c}"), 0) * sqrt(252) AS sharpe FROM sm""" for c in ("return", "bench", "turnover")
    ),
)
def describe_series(t):
    return A.describe_series(small_report(t), ["return", "bench", "turnover"])


# ---- risk and attribution --------------------------------------------------------------------------------------------

CTES["sty"] = (("wk",), """
    SELECT b.date, b.code, CASE WHEN c12 >= 12 THEN ln(m12) END AS size, s_acctbal AS value, mom AS momentum,
           CASE WHEN r12 >= 12 THEN sd END AS volatility, q.quality
    FROM (SELECT code, date, avg(amount) OVER w12 AS m12, count(amount) OVER w12 AS c12, lag(close, 4) OVER w / lag(close, 26) OVER w - 1 AS mom,
                 stddev_samp(ret) OVER w12 AS sd, count(ret) OVER w12 AS r12
          FROM (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM wk) x
          WINDOW w AS (PARTITION BY code ORDER BY date), w12 AS (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) b
    LEFT JOIN supplier ON s_suppkey = b.code
    LEFT JOIN (SELECT l_suppkey AS code, CAST(d + CAST((12 - isodow(d)) % 7 AS INTEGER) AS DATE) AS date, avg(1 - l_discount) AS quality
               FROM (SELECT *, CAST(l_shipdate AS DATE) AS d FROM lineitem) l GROUP BY 1, 2) q ON q.code = b.code AND q.date = b.date""")
CTES["wts"] = (("score",), """
    SELECT date, code, abs(score) / sum(abs(score)) OVER (PARTITION BY date) AS weight FROM
      (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS rank FROM score) t WHERE rank <= 30""")


def styles(t, panel=None, keep=()):
    """The styles of the weekly panel, or of one that adds the columns of keep to it."""
    line = t.read("lineitem").select(
        F.col("l_suppkey").alias("code"), F.next_day(F.date_sub(F.col("l_shipdate").cast("date"), 1), "FRI").alias("date"), "l_discount"
    )
    quality = line.groupBy("code", "date").agg(F.avg(1 - F.col("l_discount")).alias("quality"))
    balance = t.read("supplier").select(F.col("s_suppkey").alias("code"), F.col("s_acctbal").alias("value"))
    return Q.style_factors(t.week if panel is None else panel, quality.join(balance, "code", "left"), 12, 12, 4, 26, keep)


def weights(t):
    """Picks weighted by the size of their score; the window sees at most 30 rows per date."""
    from pyspark.sql import Window

    day = Window.partitionBy("date")
    return targets(t, 30).select("date", "code", (F.abs("score") / F.sum(F.abs("score")).over(day)).alias("weight"))


STYLE_COLUMNS = {"date": "date", "code": "int", "size": 6, "value": 4, "momentum": 6, "volatility": 6, "quality": 6}


@query("style_factors", STYLE_COLUMNS, with_ctes("sty") + "SELECT * FROM sty")
def style_factors(t):
    return styles(t)


_HELD = "SELECT w.date, w.weight, '{f}' AS style, {f} AS x FROM wts w JOIN sty s ON s.date = w.date AND s.code = w.code"
_EXP = "hl AS (" + " UNION ALL ".join(_HELD.format(f=f) for f in Q.STYLES) + """),
hz AS (SELECT *, weight / sum(weight) OVER p AS wn, avg(x) OVER p AS mu, stddev_samp(x) OVER p AS sd, count(x) OVER p AS n FROM hl
  WINDOW p AS (PARTITION BY date, style)),
ex AS MATERIALIZED (SELECT date, style, sum(CASE WHEN x IS NULL THEN 0 WHEN sd < 1e-12 THEN 0 ELSE wn * (x - mu) / sd END) AS active_exposure,
    min(mu) AS factor_mean, min(sd) AS factor_std FROM hz WHERE n >= 10 GROUP BY date, style)"""


@query(
    "style_exposure",
    {"date": "date", "style": "str", "active_exposure": 6, "factor_mean": 5, "factor_std": 5},
    with_ctes("sty", "wts", extra=_EXP) + "SELECT * FROM ex",
)
def style_exposure(t):
    return Q.style_exposure(weights(t), styles(t))


@query(
    "style_constraint",
    {"date": "date", "style": "str", "constraint_ok": "bool", "all_ok": "bool"},
    with_ctes("sty", "wts", extra=_EXP) + """SELECT date, style, abs(active_exposure) <= 0.5 AS constraint_ok,
      bool_and(abs(active_exposure) <= 0.5) OVER (PARTITION BY date) AS all_ok FROM ex""",
)
def style_constraint(t):
    return Q.style_constraint(Q.style_exposure(weights(t), styles(t)))


_HELD_BENCH = ("SELECT w.date, w.weight, k.amount AS bw, '{f}' AS style, {f} AS x FROM wts w JOIN sty s ON s.date = w.date AND s.code = w.code "
               "LEFT JOIN wk k ON k.date = w.date AND k.code = w.code")
_EXP_BENCH = "hl AS (" + " UNION ALL ".join(_HELD_BENCH.format(f=f) for f in Q.STYLES) + """),
hz AS (SELECT *, weight / sum(weight) OVER p AS wn, bw / sum(bw) OVER p AS bn, avg(x) OVER p AS mu, stddev_samp(x) OVER p AS sd, count(x) OVER p AS n
  FROM hl WINDOW p AS (PARTITION BY date, style)),
ex AS MATERIALIZED (SELECT date, style, sum(CASE WHEN x IS NULL OR sd < 1e-12 THEN 0 ELSE wn * (x - mu) / sd END) AS portfolio_exposure,
    sum(CASE WHEN x IS NULL OR sd < 1e-12 THEN 0 ELSE bn * (x - mu) / sd END) AS benchmark_exposure FROM hz WHERE n >= 10 GROUP BY date, style)"""


@query(
    "style_exposure_benchmark",
    {"date": "date", "style": "str", "portfolio_exposure": 6, "benchmark_exposure": 6, "active_exposure": 6},
    with_ctes("sty", "wts", "wk", extra=_EXP_BENCH) + "SELECT *, portfolio_exposure - benchmark_exposure AS active_exposure FROM ex",
)
def style_exposure_benchmark(t):
    """Against a benchmark that weighs names by traded amount."""
    return Q.style_exposure(weights(t), styles(t), benchmark=t.week.select("date", "code", F.col("amount").alias("weight")))


_IND = """iw AS (SELECT date, industry, sum(weight) AS w FROM wts JOIN industry USING (code) GROUP BY date, industry),
ie AS MATERIALIZED (SELECT d.date, n.industry, coalesce(w / sum(w) OVER (PARTITION BY d.date), 0) AS portfolio_weight,
    1.0 / (SELECT count(DISTINCT industry) FROM industry) AS benchmark_weight
  FROM (SELECT DISTINCT date FROM wts) d CROSS JOIN (SELECT DISTINCT industry FROM industry) n
  LEFT JOIN iw ON iw.date = d.date AND iw.industry = n.industry)"""


@query(
    "industry_exposure",
    {"date": "date", "industry": "str", "portfolio_weight": 7, "benchmark_weight": 7, "active_weight": 7},
    with_ctes("wts", "industry", extra=_IND) + "SELECT *, portfolio_weight - benchmark_weight AS active_weight FROM ie",
)
def industry_exposure(t):
    return Q.industry_exposure(weights(t), t.industry)


@query(
    "industry_exposure_benchmark",
    {"date": "date", "industry": "str", "portfolio_weight": 7, "benchmark_weight": 7, "active_weight": 7},
    with_ctes("wts", "industry", "wk", extra=_IND) + """SELECT ie.date, ie.industry, portfolio_weight, coalesce(b, 0) AS benchmark_weight,
      portfolio_weight - coalesce(b, 0) AS active_weight FROM ie LEFT JOIN
      (SELECT date, industry, sum(amount) / sum(sum(amount)) OVER (PARTITION BY date) AS b FROM wk JOIN industry USING (code) GROUP BY date, industry) bw
      ON bw.date = ie.date AND bw.industry = ie.industry""",
)
def industry_exposure_benchmark(t):
    t.keep("week")  # the picks and the benchmark both start there
    return Q.industry_exposure(weights(t), t.industry, t.week.select("date", "code", F.col("amount").alias("weight")))


@query(
    "industry_constraint",
    {"date": "date", "industry": "str", "constraint_ok": "bool", "all_ok": "bool"},
    with_ctes("wts", "industry", extra=_IND) + """SELECT date, industry, abs(portfolio_weight - benchmark_weight) <= 0.25 AS constraint_ok,
      bool_and(abs(portfolio_weight - benchmark_weight) <= 0.25) OVER (PARTITION BY date) AS all_ok FROM ie""",
)
def industry_constraint(t):
    return Q.industry_constraint(Q.industry_exposure(weights(t), t.industry))


_FM = """fr AS (SELECT s.date, size AS a, volatility AS b, r.next_return AS y FROM sty s
    JOIN (SELECT code, date, lead(close) OVER (PARTITION BY code ORDER BY date) / close - 1 AS next_return FROM wk) r
      ON r.code = s.code AND r.date = s.date WHERE size IS NOT NULL AND volatility IS NOT NULL AND r.next_return IS NOT NULL),
fs AS (SELECT date, count(*) AS n, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy
  FROM fr GROUP BY date HAVING count(*) >= 10),
fm AS MATERIALIZED (SELECT date, n, 'size' AS factor, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS factor_return FROM fs
  UNION ALL SELECT date, n, 'volatility', (byy * aa - ay * ab) / (aa * bb - ab * ab) FROM fs)"""
_TWO = ("size", "volatility")


def factor_returns(t, factors=_TWO, style_rows=None):
    forward_ret = t.week.select("code", "date", (R.ref("close", -1) / F.col("close") - 1).alias("ret"))
    return Q.fama_macbeth((styles(t) if style_rows is None else style_rows).join(forward_ret, ["code", "date"]), factors)


@query(
    "fama_macbeth",
    {"date": "date", "factor": "str", "factor_return": 6, "n": "int"},
    with_ctes("sty", extra=_FM) + "SELECT * FROM fm",
)
def fama_macbeth(t):
    return factor_returns(t)


_FIVE = """fr5 AS (SELECT s.*, r.next_return FROM sty s
  JOIN (SELECT code, date, lead(close) OVER (PARTITION BY code ORDER BY date) / close - 1 AS next_return FROM wk) r USING (code, date))"""


@query(
    "fama_macbeth_all",
    {"date": "date", "factor": "str", "factor_return": 6, "n": "int"},
    with_ctes("sty", extra=_FIVE + f""", s0 AS (SELECT *, list_transform(range({len(Q.STYLES)}), lambda x: true) AS allowed
      FROM {sql_system('fr5', 'date', Q.STYLES, 'next_return')} q WHERE n >= {5 * len(Q.STYLES)}),
      {sql_solved('fit', 's0', 'date', len(Q.STYLES))}""").replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT date, unnest([" + ", ".join(f"'{f}'" for f in Q.STYLES) + "]) AS factor, unnest(coefficients) AS factor_return, n FROM fit",
)
def fama_macbeth_all(t):
    return factor_returns(t, Q.STYLES)


@query(
    "factor_premium",
    {"factor": "str", "n_samples": "int", "premium": 6, "nw_se": 6, "t_nw": 5, "p_nw": 5, "significant": "bool"},
    with_ctes("sty", extra=_FM) + f"""SELECT factor, n_samples, mean AS premium, nw_se, t_nw, p_nw, significant
      FROM {sql_newey_west('fm', 'factor_return', 'factor')} q""",
)
def factor_premium(t):
    return Q.factor_premium(factor_returns(t))


_DEC = _EXP + ", " + _FM + """,
parts AS (SELECT ex.date, style, active_exposure * factor_return AS c FROM ex JOIN fm ON fm.date = ex.date AND fm.factor = ex.style),
dec AS MATERIALIZED (SELECT r.date, "return" - bench AS total_excess, sum(CASE WHEN style = 'size' THEN c END) AS style_size,
    sum(CASE WHEN style = 'volatility' THEN c END) AS style_volatility, sum(c) AS style_total, "return" - bench - sum(c) AS alpha
  FROM rep r JOIN parts p ON p.date = r.date GROUP BY r.date, "return", bench)"""


def decomposition(t):
    """Report first, since it keeps the weekly panel; styles are kept for exposures and factor returns."""
    rows, kept = report(t), materialize(styles(t))
    exposures = Q.style_exposure(weights(t), kept, _TWO).select("date", F.col("style").alias("factor"), F.col("active_exposure").alias("exposure"))
    return materialize(Q.decompose_excess(rows, exposures, factor_returns(t, _TWO, kept), _TWO))


@query(
    "decompose_excess",
    {"date": "date", "total_excess": 6, "style_size": 6, "style_volatility": 6, "style_total": 6, "alpha": 6},
    with_ctes("rep", "sty", "wts", extra=_DEC) + "SELECT * FROM dec",
)
def decompose_excess(t):
    return decomposition(t)


@query(
    "attribution_summary",
    {"n_days": "int", "total_excess": 4, "style_size": 4, "style_volatility": 4, "style_total": 4, "alpha": 4, "alpha_share": 5, "driver": "str",
     "t_nw": 4, "p_nw": 4, "significant": "bool"},
    with_ctes("rep", "sty", "wts", extra=_DEC) + f"""SELECT n_days, a.total_excess, style_size, style_volatility, style_total, alpha,
      CASE WHEN abs(total_excess) > 0.001 THEN abs(alpha / total_excess) END AS alpha_share,
      CASE WHEN abs(total_excess) <= 0.001 THEN 'no excess' WHEN abs(alpha / total_excess) > 0.7 THEN 'alpha'
           WHEN abs(alpha / total_excess) > 0.3 THEN 'mixed' ELSE 'style' END AS driver, t_nw, p_nw, significant
      FROM (SELECT count(*) AS n_days, avg(total_excess) * 252 AS total_excess, avg(style_size) * 252 AS style_size,
                   avg(style_volatility) * 252 AS style_volatility, avg(style_total) * 252 AS style_total, avg(alpha) * 252 AS alpha FROM dec) a,
           {sql_newey_west('dec', 'alpha', lags='20')} nw""",
)
def attribution_summary(t):
    return Q.attribution_summary(decomposition(t), _TWO)


@query("avg_daily_amount", {"code": "int", "adv": 7}, with_ctes("wk", extra=_ADV) + "SELECT code, adv0 AS adv FROM adv")
def avg_daily_amount(t):
    return Q.average_amount(t.week)


@query(
    "capacity_all_ok",
    {"date": "date", "all_ok": "bool", "max_usage": 6},
    with_ctes("wts", "wk", extra=_ADV) + """SELECT date, bool_and(coalesce(adv0, 0) > 0 AND weight * 1e5 / adv0 <= 0.05) AS all_ok,
      max(CASE WHEN coalesce(adv0, 0) <= 0 THEN 1.0 ELSE weight * 1e5 / adv0 END) AS max_usage FROM wts LEFT JOIN adv USING (code) GROUP BY date""",
)
def capacity_all_ok(t):
    return Q.capacity_passes(Q.capacity_check(weights(t), Q.average_amount(t.week), 1e5), ["date"])


@query(
    "capacity_check",
    {"date": "date", "code": "int", "position_value": 3, "usage_pct": 6, "acceptable": "bool"},
    with_ctes("wts", "wk", extra=_ADV) + """SELECT date, code, weight * 1e5 AS position_value, CASE WHEN coalesce(adv0, 0) <= 0 THEN 1.0 ELSE weight * 1e5 / adv0 END AS usage_pct,
      coalesce(adv0, 0) > 0 AND weight * 1e5 / adv0 <= 0.05 AS acceptable FROM wts LEFT JOIN adv USING (code)""",
)
def capacity_check(t):
    return Q.capacity_check(weights(t), Q.average_amount(t.week), 1e5)
