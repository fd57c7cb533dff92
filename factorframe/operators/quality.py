"""Data-quality checks of a bar panel.

Bars repeat when a feed is loaded twice. Copies of a (code, date) combine before the shuffle: counts come from an
aggregate, and checks that need the previous bar run on the first bar of each date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorframe.functions import rolling as R

# Required columns, thresholds and severities.
REQUIRED_COLUMNS = ("date", "open", "high", "low", "close", "volume", "code")
PRICE_JUMP = 0.20
ZERO_VOLUME_MOVE = 0.001
ADJUST_EVENT = 0.11
SEVERITY = {
    "duplicate_dates": "warning",
    "low_gt_high": "error",
    "open_out_of_range": "error",
    "close_out_of_range": "error",
    "extreme_price_jump": "warning",
    "zero_vol_price_change": "warning",
    "duplicate_rows": "error",
}
SAMPLES = 5
MIN_CALENDAR = 10


def check_required(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS, date: str = "date") -> DataFrame:
    """One row: missing columns, rows, rows whose date does not parse, verdict."""
    missing = [c for c in required if c not in df.columns]
    bad = F.count_if(F.col(date).isNotNull() & F.col(date).cast("string").try_cast("date").isNull()) if date in df.columns else F.lit(None).cast("bigint")
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), bad.alias("bad_dates"))
    return out.select(
        F.lit(",".join(missing)).alias("missing_columns"), "n_rows", "bad_dates",
        (F.lit(not missing) & (F.col("n_rows") > 0) & (F.coalesce("bad_dates", F.lit(0)) == 0)).alias("passed"),
    )


def duplicates(df: DataFrame) -> DataFrame:
    """Per code with repeats: extra rows beyond the first of each date, and all rows on repeated dates."""
    per_date = df.groupBy("code", "date").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return per_date.groupBy("code").agg(F.sum(F.col("_n") - 1).alias("extra_rows"), F.sum("_n").alias("all_rows"))


def _conditions() -> dict[str, Column]:
    low, high = F.col("low"), F.col("high")

    def outside(c: Column) -> Column:
        return (c < low) | (c > high)

    return {"low_gt_high": low > high, "open_out_of_range": outside(F.col("open")), "close_out_of_range": outside(F.col("close"))}


def check_ohlc(df: DataFrame) -> DataFrame:
    """Inconsistent bars per code and kind: code, type, n, sample_dates (the first five dates, comma separated)."""
    # one row per code and date first, so that a code's list of dates is bounded by the calendar
    daily = df.groupBy("code", "date").agg(*[F.count_if(c).alias(name) for name, c in _conditions().items()])

    def found(name: str) -> Column:
        dates = F.slice(F.array_sort(F.collect_list(F.when(F.col(name) > 0, F.col("date")))), 1, SAMPLES)
        text = F.array_join(F.transform(dates, lambda d: d.cast("string")), ",")
        return F.struct(F.lit(name).alias("type"), F.sum(name).alias("n"), text.alias("sample_dates")).alias(name)

    kinds = list(_conditions())
    packed = daily.groupBy("code").agg(*[found(name) for name in kinds])
    return packed.select("code", F.inline(F.array(*kinds))).where(F.col("n") > 0)


def first_bars(df: DataFrame) -> DataFrame:
    """One bar per (code, date); an aggregate keeps whichever copy has the smallest values."""
    rest = [c for c in df.columns if c not in ("code", "date")]
    return df.groupBy("code", "date").agg(F.min(F.struct(*rest)).alias("_bar")).select("code", "date", *[F.col(f"_bar.{c}").alias(c) for c in rest])


def price_jumps(bars: DataFrame, threshold: float = PRICE_JUMP) -> DataFrame:
    change = bars.select("code", "date", "close", R.ref("close", 1).alias("prev_close"), R.pct_change("close", 1).alias("change"))
    return change.where(F.abs("change") > threshold)


def zero_volume_moves(bars: DataFrame, tolerance: float = ZERO_VOLUME_MOVE) -> DataFrame:
    moved = bars.select("code", "date", "close", "volume", R.diff("close", 1).alias("move"))
    return moved.where((F.col("volume") == 0) & (F.abs("move") > tolerance))


def adjust_events(bars: DataFrame, threshold: float = ADJUST_EVENT) -> DataFrame:
    """Bars whose close moved more than a price limit allows: probable dividends or splits."""
    return price_jumps(bars, threshold).where(F.col("prev_close").isNotNull())


def validate_panel(df: DataFrame) -> DataFrame:
    """Issues of every code in long form: code, type, severity, n, sample_dates (at most five, comma separated)."""
    copies = df.groupBy("code", "date").agg(
        F.count(F.lit(1)).alias("_copies"),
        *[F.count_if(c).alias(name) for name, c in _conditions().items()],
        F.min(F.struct("open", "high", "low", "close", "volume")).alias("_bar"),
    )
    bars = copies.select("code", "date", "_copies", *_conditions(), F.col("_bar.close").alias("close"), F.col("_bar.volume").alias("volume"))
    jump = F.coalesce(F.abs(R.pct_change("close", 1)) > PRICE_JUMP, F.lit(False))
    moved = F.coalesce((F.col("volume") == 0) & (F.abs(R.diff("close", 1)) > ZERO_VOLUME_MOVE), F.lit(False))
    marked = bars.withColumns(
        {
            "duplicate_dates": F.col("_copies") - 1,
            "duplicate_rows": F.when(F.col("_copies") > 1, F.col("_copies")).otherwise(0),
            "extreme_price_jump": jump.cast("bigint"),
            "zero_vol_price_change": moved.cast("bigint"),
        }
    )
    # one row per code and date here: a code's list of flagged dates is bounded by the calendar
    summaries = []
    for name in SEVERITY:
        dates = F.array_sort(F.collect_list(F.when(F.col(name) > 0, F.col("date"))))
        text = F.array_join(F.transform(F.slice(dates, 1, SAMPLES), lambda d: d.cast("string")), ",")
        summaries.append(F.struct(F.sum(name).alias("n"), text.alias("sample_dates")).alias(name))
    packed = marked.groupBy("code").agg(*summaries)
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("type"), F.lit(severity).alias("severity"), F.col(f"{name}.n").alias("n"),
                     F.col(f"{name}.sample_dates").alias("sample_dates"))
            for name, severity in SEVERITY.items()
        ]
    )
    return packed.select("code", F.inline(rows)).where(F.col("n") > 0)


def validation_summary(df: DataFrame, issues: DataFrame) -> DataFrame:
    """Per code: rows, date range, issue count and whether it passed."""
    span = df.groupBy("code").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    found = issues.groupBy("code").agg(F.count(F.lit(1)).alias("n_issues"))
    return span.join(found, "code", "left").withColumns(
        {"n_issues": F.coalesce("n_issues", F.lit(0)), "passed": F.col("n_issues").isNull()}
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    """Codes with an issue, by severity and type with subtotals; null marks the totals."""
    return issues.rollup("severity", "type").agg(F.count(F.lit(1)).alias("n_issues"), F.sum("n").alias("n_rows"))


def coverage(panel: DataFrame, min_dates: int = MIN_CALENDAR) -> DataFrame:
    return panel.agg(F.count_distinct("code").alias("n_codes"), F.count_distinct("date").alias("n_dates")).withColumn(
        "passed", (F.col("n_codes") > 0) & (F.col("n_dates") >= min_dates)
    )
