"""Forward-return labels and relevance grades."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorframe.functions import rolling as R
from factorframe.operators.normalize import cs_zscore
from factorframe.operators.ordering import date_sized, group_median, group_quantiles, match

# Label kinds and the horizon used when a name does not parse.
LABEL_PATTERN = r"^(ret|xs_ret|alpha|up_down)_(\d+)d$"
DEFAULT_HORIZON = 20
GRADES = 5
MIDDLE_GRADE = 2


def parse_label(name: str, default_horizon: int = DEFAULT_HORIZON) -> tuple[str, int]:
    match = re.match(LABEL_PATTERN, name or "")
    return (match.group(1), int(match.group(2))) if match else ("ret", default_horizon)


def parse_label_columns(name: str | Column, default_horizon: int = DEFAULT_HORIZON) -> tuple[Column, Column]:
    """parse_label as Column expressions: (kind, horizon)."""
    name = F.col(name) if isinstance(name, str) else name
    known = name.rlike(LABEL_PATTERN)
    kind = F.when(known, F.regexp_extract(name, LABEL_PATTERN, 1)).otherwise("ret")
    horizon = F.when(known, F.regexp_extract(name, LABEL_PATTERN, 2).try_cast("int")).otherwise(default_horizon)
    return kind, horizon


def forward_return(price: str, horizon: int, by: str = "code", order: str = "date") -> Column:
    """Price at +horizon over price at +1, minus one. Entry is the next row, so the signal row is never traded."""
    return F.try_divide(R.ref(price, -horizon, by, order), R.ref(price, -1, by, order)) - 1


def label_returns(panel: DataFrame, horizon: int, price: str = "close") -> DataFrame:
    return panel.select("code", "date", forward_return(price, horizon).alias("label"))


def subtract_date_median(df: DataFrame, value: str, date: str = "date") -> DataFrame:
    medians = group_median(df, [date], value, "_median")
    return (
        df.join(date_sized(medians), date, "left").withColumn(value, F.col(value) - F.col("_median")).drop("_median")
    )


def subtract_benchmark(labels: DataFrame, benchmark: DataFrame, horizon: int) -> DataFrame:
    """label minus the benchmark's own forward return; without one for the date the label stays as it is.

    benchmark: (date, close) of the index.
    """
    forward = benchmark.withColumn("_series", F.lit("benchmark")).select(
        "date", forward_return("close", horizon, by="_series").alias("_bench")
    )
    return (
        labels.join(date_sized(forward), "date", "left")
        .withColumn("label", F.col("label") - F.coalesce("_bench", F.lit(0.0)))
        .drop("_bench")
    )


def up_down(label: str = "label") -> Column:
    return F.when(F.col(label) > 0, 1).when(F.col(label).isNotNull(), 0)


def make_label(panel: DataFrame, name: str, benchmark: DataFrame | None = None, zscore_first: bool = False) -> DataFrame:
    """Label column for names such as ret_20d, xs_ret_60d, alpha_20d, up_down_60d.

    zscore_first: an xs_ret label is standardised within each date before the median of the date goes, not left in units of return.
    """
    kind, horizon = parse_label(name)
    base = label_returns(panel, horizon)
    if kind == "xs_ret":
        return subtract_date_median(cs_zscore(base, ["label"]) if zscore_first else base, "label")
    if kind == "alpha" and benchmark is not None:
        return subtract_benchmark(base, benchmark, horizon)
    if kind == "up_down":
        return base.withColumn("label", up_down())
    return base


def quantile_grades(
    df: DataFrame, keys: list[str], value: str, bins: int = GRADES, small_group: int | None = MIDDLE_GRADE
) -> DataFrame:
    """Right-closed quantile bins 0..bins-1 per group, duplicate edges merged.

    A group with fewer rows than bins gets ``small_group`` (None leaves the grade to the edges).
    """
    names = {f"_q{i}": i / bins for i in range(bins + 1)}
    edges = group_quantiles(df, keys, value, names).select(
        *keys, F.array_sort(F.array_distinct(F.array(*names))).alias("_edges"), "n_values"
    )
    joined = match(df, edges, keys) if keys else df.crossJoin(F.broadcast(edges))
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    grade = F.size(F.filter(inner, lambda edge: edge < F.col(value)))
    if small_group is not None:
        grade = F.when(F.col("n_values") < bins, F.lit(small_group)).otherwise(grade)
    return joined.withColumn("grade", F.when(F.col(value).isNotNull(), grade)).drop("_edges", "n_values")
