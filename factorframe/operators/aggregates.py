"""Summaries by code, period and bin."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.operators.ordering import date_sized, first_k, group_quantiles
from factorframe.operators.sketches import sketch, sketch_quantiles

TRADING_DAYS = 252
SNAPSHOT_COLUMNS = ("pct_chg", "amount", "volume", "turnover_rate", "amplitude")


def statistics_by_code(panel: DataFrame) -> DataFrame:
    return panel.groupBy("code").agg(
        F.count(F.lit(1)).alias("trading_days"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.avg("close").alias("avg_close"),
        F.stddev_samp("close").alias("std_close"),
        F.sum("volume").alias("total_volume"),
        F.avg("turnover_rate").alias("avg_turnover"),
        F.avg("pct_chg").alias("avg_pct_chg"),
    )


def monthly_returns(report: DataFrame, value: str = "return", by: Sequence[str] = ()) -> DataFrame:
    """Compounded return per month: by..., year, month, value."""
    return report.groupBy(*by, F.year("date").alias("year"), F.month("date").alias("month")).agg(
        (F.product(1 + F.col(value)) - 1).alias(value)
    )


def monthly_return_grid(report: DataFrame, value: str = "return", by: Sequence[str] = ()) -> DataFrame:
    """One row per year, one column per month (m1..m12)."""
    grid = (
        report.withColumn("_month", F.month("date"))
        .groupBy(*by, F.year("date").alias("year"))
        .pivot("_month", list(range(1, 13)))
        .agg(F.product(1 + F.col(value)) - 1)
    )
    return grid.select(*by, "year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


def histogram(df: DataFrame, value: str, min_bins: int = 20, max_bins: int = 100) -> DataFrame:
    """Equal-width bins, their number n/10 clamped to the limits: bin (1-based), lower, upper, n. Empty bins omitted."""
    rows = df.where(F.col(value).isNotNull())
    span = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    span = span.withColumn("_bins", F.least(F.lit(max_bins), F.greatest(F.lit(min_bins), F.floor(F.col("_n") / 10))))
    span = span.withColumn("_w", (F.col("_hi") - F.col("_lo")) / F.col("_bins"))
    place = F.when(F.col("_w") > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")) + 1, F.col("_bins"))).otherwise(1)
    return (
        rows.select(value)
        .crossJoin(F.broadcast(span))
        .groupBy(place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_w").alias("_w"))
        .select("bin", (F.col("_lo") + (F.col("bin") - 1) * F.col("_w")).alias("lower"), (F.col("_lo") + F.col("bin") * F.col("_w")).alias("upper"), "n")
    )


def describe_series(report: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Daily mean, annualised mean and Sharpe ratio of each series column."""
    long = report.select(*by, *columns).unpivot(list(by), list(columns), "series", "value")
    mean, deviation = F.avg("value"), F.stddev_samp("value")
    return long.groupBy(*by, "series").agg(
        mean.alias("daily_mean"),
        (mean * TRADING_DAYS).alias("annual_mean"),
        F.when(deviation > 0, mean / deviation * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("sharpe"),
    )


def distinct_dates(panel: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("date") if approximate else F.count_distinct("date")
    return panel.agg(count.alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def quantile_edges(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], approximate: bool = False) -> DataFrame:
    """Interpolated quantiles of each column: feature, q0, q1, ..., n_values.

    Exact, or from one sketch per column within sketches.rank_error, which needs no order of the values.
    """
    if approximate:
        found = sketch_quantiles(sketch(df, [], columns), probabilities)
        return found.select("feature", *[f"q{i}" for i in range(len(probabilities))], F.col("n").alias("n_values"))
    long = df.select(*columns).unpivot([], list(columns), "feature", "value")
    return group_quantiles(long, ["feature"], "value", {f"q{i}": p for i, p in enumerate(probabilities)})


def market_snapshot(
    panel: DataFrame, date: str, top_n: int = 50, sort_by: str = "pct_chg", order: str = "DESC"
) -> DataFrame:
    """First rows of a day by one of the allowed columns, without ST and suspended names; top_n is 1 to 10000."""
    if not isinstance(top_n, int) or not 0 < top_n <= 10000:
        raise ValueError(f"top_n must be between 1 and 10000, not {top_n!r}")
    column = sort_by if sort_by in SNAPSHOT_COLUMNS else "pct_chg"
    rows = panel.where(F.col("date") == F.lit(date).cast("date"))
    for flag in ("is_suspended", "is_st"):
        if flag in panel.columns:
            rows = rows.where(~F.coalesce(F.col(flag), F.lit(False)))
    key = F.asc_nulls_last(column) if str(order).upper() == "ASC" else F.desc_nulls_last(column)
    return rows.orderBy(key, "code").limit(top_n)


def hit_rate(returns: DataFrame, horizons: Mapping[str, str], by: Sequence[str] = (), threshold: float = 0.0) -> DataFrame:
    """Per horizon column ({column: horizon name}): share above the threshold and the spread of returns."""
    long = returns.select(*by, *horizons).withColumnsRenamed(dict(horizons)).unpivot(
        list(by), list(horizons.values()), "horizon", "ret"
    ).where(F.col("ret").isNotNull())
    return _hit_stats(long, [*by, "horizon"], threshold)


def _hit_stats(long: DataFrame, keys: list[str], threshold: float = 0.0) -> DataFrame:
    hit = F.col("ret") > threshold
    stats = long.groupBy(*keys).agg(
        F.avg(hit.cast("double")).alias("hit_rate"),
        F.avg("ret").alias("avg_return"),
        F.max("ret").alias("max_return"),
        F.min("ret").alias("min_return"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("hits"),
    )
    medians = group_quantiles(long, keys, "ret", {"median_return": 0.5}).drop("n_values")
    return stats.join(medians, keys)


RANK_BANDS = ((1, 10), (11, 20), (21, 30))


def validation_report(returns: DataFrame, horizons: Mapping[str, str], main: str) -> DataFrame:
    """Hit rates by horizon, by rank band and by industry: scope, bucket and the measures.

    Each row is spread to the buckets it belongs to, then one aggregate serves all three scopes. Ranks beyond the bands count
    in the other scopes only.
    """
    per_horizon = [
        F.struct(F.lit("horizon").alias("scope"), F.lit(name).alias("bucket"), F.col(column).alias("ret"))
        for column, name in horizons.items()
    ]
    band = F.lit(None).cast("string")
    for low, high in RANK_BANDS:
        band = F.when(F.col("rank").between(low, high), f"rank_{low}_{high}").otherwise(band)
    others = [
        F.struct(F.lit("rank").alias("scope"), band.alias("bucket"), F.col(main).alias("ret")),
        F.struct(F.lit("industry").alias("scope"), F.col("industry").alias("bucket"), F.col(main).alias("ret")),
    ]
    long = returns.select(F.inline(F.array(*per_horizon, *others))).where(
        F.col("bucket").isNotNull() & F.col("ret").isNotNull()
    )
    return _hit_stats(long, ["scope", "bucket"])


def excess_return(returns: DataFrame, benchmark: DataFrame, column: str) -> DataFrame:
    """Mean and median excess over the benchmark return of the date (0 when absent), and its positive share."""
    rows = (
        returns.where(F.col(column).isNotNull())
        .join(date_sized(benchmark.select("date", "bench")), "date", "left")
        .select((F.col(column) - F.coalesce("bench", F.lit(0.0))).alias("excess"))
    )
    stats = rows.agg(
        F.avg("excess").alias("excess_return"),
        F.avg((F.col("excess") > 0).cast("double")).alias("excess_positive_rate"),
        F.count(F.lit(1)).alias("n"),
    )
    medians = group_quantiles(rows, [], "excess", {"excess_median": 0.5}).drop("n_values")
    return stats.crossJoin(F.broadcast(medians))


def latest_rows(df: DataFrame, k: int) -> DataFrame:
    """The k best rows of the newest date (score descending, then code)."""
    newest = df.agg(F.max("date").alias("date"))
    return first_k(df.join(F.broadcast(newest), "date", "left_semi"), ["date"], [F.desc("score"), F.col("code")], k)
