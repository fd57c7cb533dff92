"""Row selection, deduplication and universe construction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorframe.functions import flags
from factorframe.operators.joins import shift_forward
from factorframe.sources.panel import whitelist


def between_dates(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    if start:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def stock_price(panel: DataFrame, code, start: str | None = None, end: str | None = None) -> DataFrame:
    return between_dates(panel.where(F.col("code") == F.lit(code)), start, end).orderBy("date")


def price_history(
    panel: DataFrame, codes: Sequence | DataFrame, start: str, end: str, fields: Sequence[str] | None = None
) -> DataFrame:
    """Rows of several codes in a range. Give long code lists as a DataFrame: they become a semi-join."""
    chosen = panel.join(codes, "code", "left_semi") if isinstance(codes, DataFrame) else panel.where(F.col("code").isin(list(codes)))
    return whitelist(between_dates(chosen, start, end).orderBy("code", "date"), fields)


def cross_section(
    panel: DataFrame,
    date: str,
    columns: Sequence[str] | None = None,
    exclude_st: bool = True,
    exclude_suspended: bool = True,
    strict: bool = False,
) -> DataFrame:
    """All codes of one date. Unknown flags count as false, or drop the row when strict."""
    rows = panel.where(F.col("date") == F.lit(date).cast("date"))
    for wanted, flag in ((exclude_st, "is_st"), (exclude_suspended, "is_suspended")):
        if wanted:
            rows = rows.where(~F.col(flag) if strict else ~F.coalesce(F.col(flag), F.lit(False)))
    return whitelist(rows.orderBy("code"), columns)


def derive_missing(panel: DataFrame) -> DataFrame:
    """Add amount, pct_chg, preclose, turnover_rate and amplitude where the input has no such column."""
    out = panel
    if "amount" not in panel.columns:
        out = out.withColumn("amount", flags.derived_amount(None))
    added = {}
    if "pct_chg" not in panel.columns:
        added["pct_chg"] = flags.derived_pct_chg()
    if "preclose" not in panel.columns:
        added["preclose"] = flags.derived_preclose()
    for name in ("turnover_rate", "amplitude"):
        if name not in panel.columns:
            added[name] = F.lit(None).cast("double")
    return out.withColumns(added) if added else out


def with_flags(panel: DataFrame) -> DataFrame:
    """Add is_st, is_suspended and is_limit (unknown where the inputs are absent)."""
    unknown = F.lit(None).cast("boolean")
    amount = "amount" if "amount" in panel.columns else None
    out = panel.withColumn("is_st", flags.is_st() if "name" in panel.columns else unknown)
    out = out.withColumn("is_suspended", flags.is_suspended("volume", amount) if "volume" in panel.columns else unknown)
    return out.withColumn("is_limit", flags.is_one_price())


def dedupe(df: DataFrame, keys: Sequence[str], order: str | Column, keep: str = "last") -> DataFrame:
    """One row per key: the first or last by order, ties by the other columns. An aggregate, so copies of a hot key combine
    before the shuffle. Columns that cannot be ordered (maps) break no ties."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [c for c in rest if "map<" not in df.schema[c].dataType.simpleString()]
    by = F.struct((F.col(order) if isinstance(order, str) else order).alias("_order"), *ordered)
    if ordered == rest:  # the order holds the row itself, which then moves once
        packed = (F.max if keep == "last" else F.min)(by).alias("_row")
    else:
        packed = (F.max_by if keep == "last" else F.min_by)(F.struct(*rest), by).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def min_rows_filter(panel: DataFrame, min_rows: int) -> DataFrame:
    """Keep codes with at least min_rows rows."""
    enough = panel.groupBy("code").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select("code")
    return panel.join(enough, "code", "left_semi")


# Least number of bars a code needs, by bar frequency.
MIN_BARS = {"day": 500, "week": 100, "month": 24}


def universe_filter(
    instruments: DataFrame,
    calendar: DataFrame,
    st_codes: DataFrame | None = None,
    exclude_board: str | None = "bj",
    min_listed_days: int = 0,
) -> DataFrame:
    """Instrument ranges without a board and without ST codes, each start moved N trading days forward."""
    out = instruments
    if exclude_board:
        out = out.where(~F.lower(F.col("code").cast("string")).startswith(exclude_board))
    if st_codes is not None:
        out = out.join(st_codes.select("code").distinct(), "code", "left_anti")
    if min_listed_days > 0:
        out = shift_forward(out, calendar, "start_date", min_listed_days, "end_date")
        out = out.where(F.col("start_date") <= F.col("end_date"))
    return out


def index_members(instruments: DataFrame, members: DataFrame) -> DataFrame:
    return instruments.join(members.select("code"), "code", "left_semi")


def missing_members(instruments: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(instruments.select("code"), "code", "left_anti")


def segment_split(df: DataFrame, segments: Mapping[str, tuple[str, str]], date: str = "date") -> DataFrame:
    """Add ``segment``: the first closed date range holding the row; rows outside all ranges are dropped."""
    label = F.lit(None).cast("string")
    for name, (start, end) in reversed(list(segments.items())):
        label = F.when(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")), name).otherwise(label)
    return df.withColumn("segment", label).where(F.col("segment").isNotNull())


def keep_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows on a discrete set of dates (for example the train dates around a purged test block)."""
    return df.join(dates.select("date"), "date", "left_semi")


def range_check(calendar: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (name, start_date, end_date) against the first and last calendar date: adds inside."""
    span = calendar.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return ranges.crossJoin(F.broadcast(span)).withColumn(
        "inside", (F.col("start_date") >= F.col("first_date")) & (F.col("end_date") <= F.col("last_date"))
    )


def flat_runs(series: DataFrame, value: str, by: Sequence[str] = (), order: str = "date", min_length: int = 5) -> DataFrame:
    """Runs of an unchanged value at least min_length rows long: by..., value, start, end, length."""
    keys = list(by)
    ordered = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    previous = F.lag(value).over(ordered)
    changed = F.when(previous.isNull() | (previous != F.col(value)), 1).otherwise(0)
    marked = series.where(F.col(value).isNotNull()).withColumn("_new", changed)
    runs = marked.withColumn("_run", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.groupBy(*keys, "_run")
        .agg(
            F.min(value).alias(value), F.min(order).alias("start_date"), F.max(order).alias("end_date"),
            F.count(F.lit(1)).alias("length"),
        )
        .where(F.col("length") >= min_length)
        .drop("_run")
    )
