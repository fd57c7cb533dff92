"""Approximate quantiles by mergeable sketches, for windows whose rows are too many to sort again each day.

A KLL sketch of size k answers any quantile of n values with a rank error of at most `rank_error(k)` times n, with 99 % confidence,
whatever the distribution; equal values do not widen it. Sketches of days add up, so a day's rows are read once and every window
over them is a merge of small binaries. Exact quantiles are `ordering.group_quantiles`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.operators.ordering import date_sized

SIZE = 400


def rank_error(size: int = SIZE, many: bool = False) -> float:
    """Bound of the rank error as a share of the rows (published formula of KLL sketches, 99 % confidence for one quantile).

    many: twice that, some five standard deviations, which thousands of quantiles hold together.
    """
    return (2 if many else 1) * 2.296 / size ** 0.9723


def sketch(rows: DataFrame, by: Sequence[str], columns: Sequence[str], size: int = SIZE) -> DataFrame:
    """by..., feature, sketch, n: one small binary per group and column, with partial sketches before the shuffle. Null is no value."""
    long = rows.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(by), list(columns), "feature", "_x").where(
        F.col("_x").isNotNull() & ~F.isnan("_x"))
    return long.groupBy(*by, "feature").agg(F.kll_sketch_agg_double("_x", F.lit(size)).alias("sketch"), F.count("_x").alias("n"))


def merged(sketches: DataFrame, by: Sequence[str], size: int = SIZE) -> DataFrame:
    """by..., feature, sketch, n of coarser groups."""
    return sketches.groupBy(*by, "feature").agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"), F.sum("n").alias("n"))


def trailing(sketches: DataFrame, calendar: DataFrame, days: int, size: int = SIZE) -> DataFrame:
    """date, feature, sketch, n over the last `days` dates of the calendar up to each date. calendar: date, idx."""
    indexed = sketches.join(date_sized(calendar.select("date", "idx")), "date").drop("date")
    spread = indexed.withColumn("idx", F.explode(F.sequence(F.col("idx"), F.col("idx") + days - 1)))  # sketches, not rows
    return merged(spread, ["idx"], size).join(date_sized(calendar.select("date", "idx")), "idx").drop("idx")


def sketch_quantiles(sketches: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """The columns of sketches but the sketch, and q0, q1, ..."""
    qs = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(probabilities)]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *qs)


def observed_error(rows: DataFrame, quantiles: DataFrame, by: Sequence[str], column: str, probabilities: Sequence[float]) -> DataFrame:
    """by..., n, error: the largest rank error, as a share of the rows, of quantiles (by..., q0, q1, ...) against the rows themselves.

    A value covers all ranks of its copies, so the error counts from the nearest of them.
    """
    qs = [f"q{i}" for i in range(len(probabilities))]
    x = F.col(column)
    met = rows.select(*by, column).where(x.isNotNull()).join(F.broadcast(quantiles.select(*by, *qs)), list(by))  # a row per group
    n = F.count(F.lit(1))
    counts = met.groupBy(*by).agg(n.alias("n"), *[F.count_if(x < F.col(q)).alias(f"_b{q}") for q in qs], *[F.count_if(x <= F.col(q)).alias(f"_u{q}") for q in qs])
    errors = [F.greatest(F.col(f"_b{q}") / F.col("n") - p, p - F.col(f"_u{q}") / F.col("n"), F.lit(0.0)) for q, p in zip(qs, probabilities)]
    return counts.select(*by, "n", F.greatest(*errors, F.lit(0.0)).alias("error"))
