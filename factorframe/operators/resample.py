"""Daily bars to weekly or monthly bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICE_FIELDS = ("open", "high", "low", "close", "volume", "amount")


def period_end(date: str | Column, freq: str) -> Column:
    """Label of the period a date falls in: its Friday, or the last day of its month."""
    date = F.col(date) if isinstance(date, str) else date
    if freq == "week":
        return F.next_day(F.date_sub(date, 1), "FRI")
    if freq == "month":
        return F.last_day(date)
    raise ValueError(f"unknown frequency {freq!r}")


def resample(panel: DataFrame, freq: str, code: str = "code", date: str = "date") -> DataFrame:
    """First open, highest high, lowest low, last close, summed volume and amount; incomplete periods dropped.

    open and close skip nulls, as a first/last over present values does. Rows move once, by code: that serves the
    grouping by (code, period) and every later window over a code, whose rows are bounded by the calendar.
    """
    return (
        panel.repartition(code)
        .groupBy(code, period_end(date, freq).alias("_end"))
        .agg(
            F.min_by("open", F.when(F.col("open").isNotNull(), F.col(date))).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", F.when(F.col("close").isNotNull(), F.col(date))).alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("amount").alias("amount"),
        )
        .withColumnRenamed("_end", date)
        .na.drop(subset=list(PRICE_FIELDS))
        .select(code, date, *PRICE_FIELDS)
    )
