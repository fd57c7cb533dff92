"""Leak-free time-series splits and their evaluation, all folds in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorframe.operators.ic import icir_summary, rank_ic

MIN_TRAIN_DAYS = 252


def calendar_days(trading_days: int) -> int:
    """Trading days as calendar days, scaled by 7/5 and truncated."""
    return int(trading_days * 7 / 5)


def purged_kfold(
    calendar: DataFrame,
    n_splits: int = 5,
    label_horizon: int = 20,
    purge_days: int | None = None,
    embargo_days: int | None = None,
) -> DataFrame:
    """fold, date, role (train or test) for k contiguous test blocks.

    A train date is kept when its label window ends before the purged start of the block, or when it lies after the
    embargo. calendar: (date, idx) with idx from 0. Folds without train or test dates are dropped.
    """
    purge = calendar_days(label_horizon if purge_days is None else purge_days)
    embargo = calendar_days(max(1, label_horizon // 2) if embargo_days is None else embargo_days)
    label = calendar_days(label_horizon)
    n = calendar.agg(F.count(F.lit(1)).alias("_n"))
    folds = n.select(F.col("_n"), F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
    bounds = folds.select(
        "fold",
        F.floor(F.col("_n") * F.col("fold") / n_splits).alias("_first"),
        (F.floor(F.col("_n") * (F.col("fold") + 1) / n_splits) - 1).alias("_last"),
    )
    blocks = (
        calendar.join(F.broadcast(bounds), F.col("idx").between(F.col("_first"), F.col("_last")))
        .groupBy("fold", "_first", "_last")
        .agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    )
    rows = calendar.crossJoin(F.broadcast(blocks))  # one row per fold
    in_test = F.col("idx").between(F.col("_first"), F.col("_last"))
    before = F.date_add("date", label) < F.date_sub("_from", purge)
    after = F.col("date") > F.date_add("_to", embargo)
    role = F.when(in_test, "test").when(before | after, "train")
    split = rows.select("fold", "date", role.alias("role")).where(F.col("role").isNotNull())
    usable = split.groupBy("fold").agg(F.count_distinct("role").alias("_roles")).where(F.col("_roles") == 2)
    return split.join(F.broadcast(usable), "fold", "left_semi")


def walk_forward(
    spark: SparkSession,
    start: str | Column,
    end: str | Column,
    train_years: float = 3.0,
    step_months: int = 6,
    test_years: float = 1.0,
    label_horizon: int = 0,
    gap_mode: str = "reference",
    source: DataFrame | None = None,
) -> DataFrame:
    """Rolling train / valid / test windows: fold and six dates.

    gap_mode "reference" moves train end, valid start, valid end and test start back by the label gap alike. "strict"
    shortens only the train and valid ends, which leaves a real gap before the next segment.
    source: one-row DataFrame that start and end refer to when they are columns.
    """
    base = source if source is not None else spark.range(1)
    first = F.lit(start).cast("date") if isinstance(start, str) else start
    last = F.lit(end).cast("date") if isinstance(end, str) else end
    gap = calendar_days(label_horizon) if label_horizon > 0 else 0
    train_months, test_months = int(train_years * 12), int(test_years * 12)
    bounds = base.select(first.alias("_start"), last.alias("_end"))
    # every step starts from the previous start: month ends clamp once and stay clamped
    steps = F.ceil(F.greatest(F.months_between("_end", "_start"), F.lit(0.0)) / step_months).cast("int")
    starts = F.aggregate(
        F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
        F.array(F.col("_start")),
        lambda done, _: F.concat(done, F.array(F.add_months(F.element_at(done, -1), step_months))),
    )
    windows = bounds.select("_start", "_end", F.posexplode(starts).alias("fold", "train_start"))
    raw = windows.withColumn("_train", F.add_months("train_start", train_months))
    raw = raw.withColumn("_test", F.add_months("_train", test_months))
    raw = raw.withColumn("_stop", F.add_months("_test", test_months)).where(F.col("_test") < F.col("_end"))
    moved = gap if gap_mode == "reference" else 0
    return raw.select(
        "fold",
        "train_start",
        F.date_sub("_train", gap).alias("train_end"),
        F.date_sub("_train", moved).alias("valid_start"),
        F.least(F.date_sub("_test", gap), F.col("_end")).alias("valid_end"),
        F.date_sub("_test", moved).alias("test_start"),
        F.least("_stop", "_end").alias("test_end"),
    )


def min_train_guard(splits: DataFrame, min_days: int = MIN_TRAIN_DAYS) -> DataFrame:
    """Drop folds with fewer than min_days train dates."""
    enough = splits.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("_n")).where(F.col("_n") >= min_days)
    return splits.join(F.broadcast(enough), "fold", "left_semi")


def cv_evaluate(pairs: DataFrame, splits: DataFrame, label_horizon: int, role: str = "test") -> DataFrame:
    """IC summary per fold on its test dates. pairs: (date, score, label), plus fold when each fold has its own scores.

    Scores common to all folds are ranked once per date; only the date-sized IC meets the folds. splits has at most one row per
    fold and date, so it is the side that is broadcast.
    """
    dates = F.broadcast(splits.where(F.col("role") == role).select("fold", "date"))
    if "fold" in pairs.columns:
        ic = rank_ic(pairs.join(dates, ["fold", "date"]), ["fold", "date"])
    else:
        ic = rank_ic(pairs, ["date"]).join(dates, "date")
    return icir_summary(ic, ["fold"], max_lags=label_horizon)


def fit_range_end(splits: DataFrame) -> DataFrame:
    """Last date a normaliser may see per fold: the last train date before the test block, else the last train date."""
    test = splits.where(F.col("role") == "test").groupBy("fold").agg(F.min("date").alias("_test"))
    train = splits.where(F.col("role") == "train").join(F.broadcast(test), "fold")
    return train.groupBy("fold").agg(
        F.coalesce(F.max(F.when(F.col("date") < F.col("_test"), F.col("date"))), F.max("date")).alias("fit_end")
    )
