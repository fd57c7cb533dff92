"""Cross-sectional and fitted normalisation.

Group statistics come from aggregates (partial sums on the map side) and return to the rows by a broadcast of one row
per date, so the panel itself is not shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorframe.operators.ordering import date_sized, group_quantiles
from factorframe.session import materialize

# Fixed value: median absolute deviation to standard deviation under normality.
MAD_SCALE = 1.4826


def cs_zscore(df: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """(x - mean) / std within each date; null where the deviation is zero or undefined."""
    stats = df.groupBy(date).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns]
    )
    joined = df.join(date_sized(stats), date)
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


def zscore_fit(df: DataFrame, columns: Sequence[str], fit: Column) -> DataFrame:
    """(x - mean) / std with statistics from the rows where fit holds, applied to all rows."""
    stats = df.where(fit).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns]
    )
    joined = df.crossJoin(F.broadcast(stats))  # one row of statistics
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


def robust_zscore_fit(df: DataFrame, columns: Sequence[str], fit: Column, clip: float | None = None) -> DataFrame:
    """(x - median) / (1.4826 * MAD), both from the fit rows, optionally clipped to [-clip, clip]."""
    long = df.where(fit).select(*columns).unpivot([], list(columns), "_feature", "_x")
    medians = group_quantiles(long, ["_feature"], "_x", {"_med": 0.5}).drop("n_values")
    spread = long.join(F.broadcast(medians), "_feature").withColumn("_x", F.abs(F.col("_x") - F.col("_med")))
    mads = group_quantiles(spread, ["_feature"], "_x", {"_mad": 0.5}).drop("n_values")
    stats = medians.join(mads, "_feature").groupBy().pivot("_feature", list(columns)).agg(
        F.first("_med").alias("med"), F.first("_mad").alias("mad")
    )
    joined = df.crossJoin(F.broadcast(stats))

    def scale(c: str) -> Column:
        z = F.when(F.col(f"{c}_mad") > 0, (F.col(c) - F.col(f"{c}_med")) / (F.col(f"{c}_mad") * MAD_SCALE))
        return z if clip is None else F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))

    return joined.withColumns({c: scale(c) for c in columns}).select(*df.columns)


def drop_null_label(df: DataFrame, label: str = "label") -> DataFrame:
    return df.na.drop(subset=[label])


def fill_null(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.na.fill(dict(values))


def neutralize(df: DataFrame, value: str, industry: str, size: str, date: str = "date") -> DataFrame:
    """Residual of value on industry means and size within each date (demean both, then one slope per date).

    Only rows with all three present take part; the output column is ``residual``.
    """
    present = F.col(value).isNotNull() & F.col(size).isNotNull() & F.col(industry).isNotNull()
    n = F.count(F.lit(1))
    # centred sums per date and industry add up to those of the date; the table has dates x industries rows
    cells = df.where(present).groupBy(date, industry).agg(
        F.avg(value).alias("_mv"), F.avg(size).alias("_ms"), (F.covar_pop(value, size) * n).alias("_vs"), (F.var_pop(size) * n).alias("_ss"))
    day = Window.partitionBy(date)
    total = F.sum("_ss").over(day)
    beta = F.when(total > 1e-12, F.sum("_vs").over(day) / total).otherwise(0.0)
    known = materialize(cells.select(date, industry, "_mv", "_ms", beta.alias("_beta")))
    residual = (F.col(value) - F.col("_mv")) - F.col("_beta") * (F.col(size) - F.col("_ms"))
    return df.where(present).join(known, [date, industry]).select(*df.columns, residual.alias("residual"))
