"""Market regimes of an index and results per regime or year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.functions import rolling as R
from factorframe.operators.filters import flat_runs
from factorframe.operators.order_windows import window_quantile
from factorframe.operators.ordering import date_sized

REGIMES = ("bull", "strong_bull", "bear", "strong_bear")
KEY_YEARS = (2015, 2018, 2020, 2022, 2024)
FLAT_RUN = 5


def classify_regime(index: DataFrame, ma_window: int = 60, vol_window: int = 60, price: str = "close", by: str | None = None) -> DataFrame:
    """Regime per date of an index (date, price), from its moving average and its volatility against the median so far.

    Only past rows count: the volatility median expands and needs 2 * vol_window values. Earlier dates are dropped.
    """
    series = by or "_series"
    rows = index if by else index.withColumn(series, F.lit(0))
    past = rows.select(series, "date", F.col(price).alias("price"), R.pct_change(price, 1, by=series).alias("_ret"))
    staged = past.withColumns({"ma": R.mean("price", ma_window, by=series), "vol": R.std("_ret", vol_window, by=series)})
    judged = window_quantile(staged, "vol", "_median", min_periods=2 * vol_window, by=series)
    calm = F.col("vol") < F.col("_median")
    above = F.col("price") > F.col("ma")
    regime = (
        F.when(above & calm, "bull").when(above, "strong_bull").when(calm, "bear").otherwise("strong_bear")
    )
    complete = judged.where(F.col("price").isNotNull() & F.col("ma").isNotNull() & F.col("vol").isNotNull() & F.col("_median").isNotNull())
    return complete.select(*([by] if by else []), "date", "price", "ma", "vol", regime.alias("regime"))


def regime_ic(ic: DataFrame, regimes: DataFrame, min_days: int = 6) -> DataFrame:
    mean, deviation = F.avg("ic"), F.stddev_samp("ic")
    return (
        ic.join(date_sized(regimes.select("date", "regime")), "date")
        .groupBy("regime")
        .agg(
            F.count(F.lit(1)).alias("n_days"), mean.alias("ic_mean"), deviation.alias("ic_std"),
            F.when(deviation > 0, mean / deviation).alias("icir"),
            F.avg((F.col("ic") > 0).cast("double")).alias("ic_positive_ratio"),
        )
        .where(F.col("n_days") >= min_days)
    )


def key_years(ic: DataFrame, returns: DataFrame, years: Sequence[int] = KEY_YEARS) -> DataFrame:
    """Rank IC and return measures per chosen year; returns: (date, return, bench)."""
    mean, deviation = F.avg("ic"), F.stddev_samp("ic")
    from_ic = ic.where(F.year("date").isin(list(years))).groupBy(F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("n_days"), mean.alias("ic_mean"), F.when(deviation > 0, mean / deviation).alias("icir")
    )
    from_returns = returns.where(F.year("date").isin(list(years))).groupBy(F.year("date").alias("year")).agg(
        (F.product(1 + F.col("return")) - 1).alias("total_return"), (F.product(1 + F.col("bench")) - 1).alias("bench_return")
    )
    return from_ic.join(from_returns, "year", "left")


def benchmark_check(index: DataFrame, start: str, end: str, price: str = "close") -> DataFrame:
    """One row: rows, first and last date, whether they cover [start, end], longest unchanged run, verdict."""
    runs = flat_runs(index, price, min_length=1).agg(F.max("length").alias("longest_flat_run"))
    span = index.agg(F.count(price).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    covered = (F.col("first_date") <= F.lit(start).cast("date")) & (F.col("last_date") >= F.lit(end).cast("date"))
    longest = F.coalesce("longest_flat_run", F.lit(0))
    return span.crossJoin(runs).select(
        "n_rows", "first_date", "last_date", F.coalesce(covered, F.lit(False)).alias("covered"), longest.alias("longest_flat_run"),
        ((F.col("n_rows") > 0) & F.coalesce(covered, F.lit(False)) & (longest < FLAT_RUN)).alias("passed"),
    )


