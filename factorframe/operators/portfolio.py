"""Returns of target holdings, and performance of return series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorframe.functions import flags
from factorframe.functions import rolling as R
from factorframe.operators.ordering import date_sized
from factorframe.operators.picks import rebalance_trades

TRADING_DAYS = 252
# Cost of buying and of selling, as shares of the traded value.
OPEN_COST, CLOSE_COST = 0.0005, 0.0015


def execution_view(panel: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Per (code, date): return from the next open to the one after, and whether the next bar is locked.

    listed: (code, listed) with exchange prefixes; without it the code itself decides the board.
    """
    bars = panel.select(
        "code",
        "date",
        (F.try_divide(R.ref("open", -2), R.ref("open", -1)) - 1).alias("next_return"),
        R.ref("close", -1).alias("_next_close"),
        (F.try_divide(R.ref("close", -1), F.col("close")) - 1).alias("_change"),
    )
    named = bars.join(listed, "code", "left") if listed is not None else bars.withColumn("listed", F.col("code").cast("string"))
    board = flags.board_class(F.coalesce("listed", F.lit("")))
    return named.select(
        "code", "date", "next_return",
        flags.limit_buy("_change", "_next_close", board).alias("no_buy"),
        flags.limit_sell("_change", "_next_close", board).alias("no_sell"),
    )


def portfolio_returns(
    targets: DataFrame, execution: DataFrame, benchmark: DataFrame | None = None, open_cost: float = OPEN_COST,
    close_cost: float = CLOSE_COST, min_cost: float = 0.0, account: float = 1e8,
) -> DataFrame:
    """Equal-weight return, turnover and cost per date of a full rebalance into the targets.

    An order costs its rate, but at least min_cost of an account worth account.

    Orders fill at the next open. A blocked buy leaves the holding out; a blocked sell keeps the name for that period.
    """
    orders = rebalance_trades(targets, keep=True).groupBy("date", "code").agg(
        F.max((F.col("action") == "BUY").cast("int")).alias("_buy"), F.max((F.col("action") == "SELL").cast("int")).alias("_sell")
    )
    # Spark broadcasts the orders where their size allows
    filled = orders.join(execution, ["date", "code"], "left")
    no_buy, no_sell = F.coalesce("no_buy", F.lit(True)), F.coalesce("no_sell", F.lit(False))
    bought = (F.col("_buy") == 1) & ~no_buy
    sold = (F.col("_sell") == 1) & ~no_sell
    held = ((F.col("_buy") == 0) & (F.col("_sell") == 0)) | bought | ((F.col("_sell") == 1) & no_sell)
    daily = filled.groupBy("date").agg(
        F.avg(F.when(held, F.col("next_return"))).alias("return"),
        F.count_if(held).alias("n_held"),
        F.count_if(bought).alias("_buys"),
        F.count_if(sold).alias("_sells"),
        F.count_if(F.col("_sell") == 0).alias("_n"),
    )
    size = F.greatest(F.col("_n"), F.lit(1))

    def fee(rate: float):
        return F.greatest(F.lit(rate) / size, F.lit(min_cost / account))

    out = daily.select(
        "date", F.coalesce("return", F.lit(0.0)).alias("return"), "n_held",
        ((F.col("_buys") + F.col("_sells")) / size / 2).alias("turnover"),
        (F.col("_buys") * fee(open_cost) + F.col("_sells") * fee(close_cost)).alias("cost"),
    )
    if benchmark is None:
        return out
    return out.join(date_sized(benchmark.select("date", "bench")), "date", "left").withColumn("bench", F.coalesce("bench", F.lit(0.0)))


def pick_forward_returns(
    picks: DataFrame, panel: DataFrame, horizons: Sequence[int] = (5, 10, 20), price: str = "open", lag: int = 1
) -> DataFrame:
    """Entry price `lag` rows after the pick and the return over each horizon; picks that cannot be entered are dropped.

    picks holds a few rows per date; Spark broadcasts it where its size allows.
    """
    prices = panel.select(
        "code", "date", (R.ref(price, -lag) if lag else F.col(price)).alias("rec_price"),
        *[R.ref(price, -(lag + h)).alias(f"_p{h}") for h in horizons],
    )
    joined = prices.join(picks, ["code", "date"]).where(F.col("rec_price").isNotNull())
    returns = {f"ret_{h}d": F.try_divide(F.col(f"_p{h}") - F.col("rec_price"), F.col("rec_price")) for h in horizons}
    return joined.withColumns(returns).drop(*[f"_p{h}" for h in horizons])


def _series(report: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (report, list(by)) if by else (report.withColumn("_series", F.lit(0)), ["_series"])


def cumulative_return(report: DataFrame, columns: Sequence[str] = ("return", "bench"), by: Sequence[str] = ()) -> DataFrame:
    """Running product of 1 + return per series. One row per date and strategy, so windows stay calendar sized."""
    rows, keys = _series(report, by)
    past = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*by, "date", *[F.product(1 + F.col(c)).over(past).alias(f"cum_{c}") for c in columns])


def drawdown(report: DataFrame, column: str = "return", by: Sequence[str] = ()) -> DataFrame:
    rows, keys = _series(report, by)
    past = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = rows.withColumn("_cum", F.product(1 + F.col(column)).over(past))
    peak = F.max("_cum").over(past)
    return wealth.select(*by, "date", F.col("_cum").alias("cum"), ((F.col("_cum") - peak) / peak).alias("drawdown"))


def max_drawdown(report: DataFrame, column: str = "return", by: Sequence[str] = ()) -> DataFrame:
    falls = drawdown(report, column, by)
    return falls.groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"), F.min_by("date", "drawdown").alias("trough_date"))


def rolling_sharpe(report: DataFrame, window: int = 60, column: str = "return", by: Sequence[str] = ()) -> DataFrame:
    rows, keys = _series(report, by)
    frame = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(window - 1), 0)
    full = F.count(column).over(frame) >= window
    value = F.try_divide(F.avg(column).over(frame), F.stddev_samp(column).over(frame)) * F.sqrt(F.lit(float(TRADING_DAYS)))
    return rows.select(*by, "date", F.when(full, value).alias("sharpe")).where(F.col("sharpe").isNotNull())


def perf_summary(report: DataFrame, by: Sequence[str] = (), periods: int = TRADING_DAYS) -> DataFrame:
    """Annual return and volatility, Sharpe, drawdown, Calmar, win rate, excess return and information ratio."""
    root = F.sqrt(F.lit(float(periods)))
    excess = F.col("return") - F.col("bench")
    deviation, tracking = F.stddev_samp("return"), F.stddev_samp(excess)
    stats = report.groupBy(*by).agg(
        (F.avg("return") * periods).alias("annual_return"),
        (deviation * root).alias("annual_vol"),
        F.when(deviation > 0, F.avg("return") / deviation * root).alias("sharpe"),
        F.avg((F.col("return") > 0).cast("double")).alias("win_rate"),
        (F.avg(excess) * periods).alias("annual_excess"),
        F.when(tracking > 0, F.avg(excess) / tracking * root).alias("information_ratio"),
    )
    falls = max_drawdown(report, by=by)
    joined = stats.join(falls, list(by)) if by else stats.crossJoin(F.broadcast(falls))
    return joined.withColumn("calmar", F.try_divide("annual_return", F.abs("max_drawdown")))


def cost_drag(report: DataFrame, by: Sequence[str] = (), open_cost: float = OPEN_COST, close_cost: float = CLOSE_COST) -> DataFrame:
    turnover = F.avg("turnover") * TRADING_DAYS
    before = F.avg("return") * TRADING_DAYS - F.coalesce(F.avg("bench"), F.lit(0.0)) * TRADING_DAYS
    drag = turnover * (open_cost + close_cost)
    return report.groupBy(*by).agg(
        turnover.alias("annual_turnover"), drag.alias("annual_cost"), before.alias("excess_before_cost"),
        (before - drag).alias("excess_after_cost"), (before - drag < 0).alias("negative_after_cost"),
    )
