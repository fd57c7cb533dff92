"""Distribution drift (PSI), decay of an IC series and stability of importances."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorframe.functions.stats import correlation
from factorframe.operators.ordering import average_ranks, group_quantiles
from factorframe.session import materialize

FLOOR = 1e-6
# Drift levels.
MODERATE, SIGNIFICANT = 0.1, 0.25
STABLE, WARNING = 0.7, 0.5


def bin_counts(rows: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """feature, _bin, _n: how many values of each feature (a column) lie in each bin of its sorted edges, per task.

    Bins count from 1. Rows stay where they are, in their wide form: a task sends one number per feature and bin. NaN is above all numbers.
    """
    features = list(edges)
    marks = [np.array(edges[f], dtype=float) for f in features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(m), np.int64) for m in marks]
        for batch in batches:
            for i, mark in enumerate(marks):
                values = np.asarray(batch.column(i).drop_null())
                passed = np.searchsorted(mark, values, "right")
                inside = (passed > 0) & (np.searchsorted(mark, values, "left") < len(mark))
                totals[i] += np.bincount(np.minimum(passed[inside], len(mark) - 1), minlength=len(mark))
        cells = [(f, j, int(n)) for f, total in zip(features, totals) for j, n in enumerate(total) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[0] for c in cells], pa.string()), pa.array([c[1] for c in cells], pa.int32()), pa.array([c[2] for c in cells], pa.int64())],
            names=["feature", "_bin", "_n"])

    schema = "feature string, _bin int, _n long"
    if not features:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.select(*[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]).mapInArrow(run, schema)


def psi(baseline: DataFrame, actual: DataFrame, features: Sequence[str], bins: int = 10, **pieces: int) -> DataFrame:
    """Population stability index of every feature at once: feature, psi.

    Edges are baseline quantiles with duplicates merged (equal widths when the baseline has fewer rows than bins). Bins
    are closed on the left, the last one on both sides; values outside the edges do not count. A side without any
    counted value gives null. Only the edges (bins + 1 numbers per feature) leave the tasks; they are written once, as two steps read them.
    """
    base = baseline.select(*features).unpivot([], list(features), "feature", "value").where(F.col("value").isNotNull())
    names = {f"_q{i}": i / bins for i in range(bins + 1)}
    quantiles = group_quantiles(base, ["feature"], "value", names, **pieces)
    last = f"_q{bins}"
    width = (F.col(last) - F.col("_q0")) / bins
    even = F.array(*[F.col("_q0") + width * i for i in range(bins)], F.col(last))
    edges = materialize(quantiles.select(
        "feature",
        F.array_sort(F.array_distinct(F.when(F.col("n_values") < bins, even).otherwise(F.array(*names)))).alias("_edges"),
    ))
    marks = {r["feature"]: r["_edges"] for r in edges.collect()}  # bins + 1 numbers per feature
    counted = (
        bin_counts(baseline, marks).withColumns({"_e": F.col("_n"), "_a": F.lit(0)})
        .unionByName(bin_counts(actual, marks).withColumns({"_e": F.lit(0), "_a": F.col("_n")}))
        .groupBy("feature", "_bin").agg(F.sum("_e").alias("_e"), F.sum("_a").alias("_a"))
    )
    grid = edges.where(F.size("_edges") > 1).select("feature", F.explode(F.sequence(F.lit(1), F.size("_edges") - 1)).alias("_bin"))
    whole = Window.partitionBy("feature")  # at most `bins` rows per feature from here on
    filled = grid.join(counted, ["feature", "_bin"], "left").na.fill(0, ["_e", "_a"])
    shares = filled.select(
        "feature",
        F.greatest(F.try_divide("_e", F.sum("_e").over(whole)), F.lit(FLOOR)).alias("_e"),
        F.greatest(F.try_divide("_a", F.sum("_a").over(whole)), F.lit(FLOOR)).alias("_a"),
        F.sum("_a").over(whole).alias("_in_range"),
    )
    scaled = shares.select(
        "feature", "_in_range", (F.col("_e") / F.sum("_e").over(whole)).alias("_e"), (F.col("_a") / F.sum("_a").over(whole)).alias("_a")
    )
    terms = (F.col("_a") - F.col("_e")) * F.log(F.col("_a") / F.col("_e"))
    return scaled.groupBy("feature").agg(F.when(F.max("_in_range") > 0, F.sum(terms)).alias("psi"))


def psi_table(baseline: DataFrame, actual: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    level = F.when(F.col("psi") < MODERATE, "low").when(F.col("psi") < SIGNIFICANT, "moderate").otherwise("significant")
    return psi(baseline, actual, features, bins).withColumn("drift_level", level).orderBy(F.desc("psi"), "feature")


def concept_drift(ic: DataFrame, window: int = 60, threshold: float = 0.3, by: Sequence[str] = ()) -> DataFrame:
    """Rolling mean, deviation and trend of an IC series, with a warning on its last `window` rows.

    The warning compares the rolling mean over rows window..2*window-1 with that over the last window rows.
    """
    keys = list(by)
    rows = ic if keys else ic.withColumn("_series", F.lit(0))
    part = keys or ["_series"]
    ordered = Window.partitionBy(*part).orderBy("date")
    frame = ordered.rowsBetween(-(window - 1), 0)

    def strict(value, counted):
        return F.when(F.count(counted).over(frame) >= window, value)

    staged = rows.withColumns(
        {
            "_i": F.row_number().over(ordered) - 1,
            "_n": F.count(F.lit(1)).over(Window.partitionBy(*part)),
            "rolling_ic": strict(F.avg("ic").over(frame), F.col("ic")),
            "rolling_std": strict(F.stddev_samp("ic").over(frame), F.col("ic")),
        }
    ).withColumn("trend", strict(F.regr_slope(F.col("rolling_ic"), F.col("_i")).over(frame), F.col("rolling_ic")))
    early = (F.col("_i") >= window) & (F.col("_i") < 2 * window)
    late = F.col("_i") >= F.col("_n") - window
    whole = Window.partitionBy(*part)
    out = staged.withColumns(
        {
            "_base": F.avg(F.when(early, F.col("rolling_ic"))).over(whole),
            "_recent": F.avg(F.when(late, F.col("rolling_ic"))).over(whole),
        }
    )
    declined = (F.col("_n") > window) & (F.col("_base") > 0) & ((F.col("_base") - F.col("_recent")) / F.col("_base") > threshold)
    return out.select(
        *keys, "date", "ic", "rolling_ic", "rolling_std", "trend", F.coalesce(late & declined, F.lit(False)).alias("drift_warning")
    )


def importance_stability(importances: DataFrame, min_common: int = 5) -> DataFrame:
    """Mean Spearman correlation of importances between consecutive folds (fold, feature, importance): one row.

    1 when there is a single fold, 0 when no pair has more than min_common shared features.
    """
    later = importances.select((F.col("fold") - 1).alias("fold"), "feature", F.col("importance").alias("next_importance"))
    pairs = importances.join(later, ["fold", "feature"])
    ranked = average_ranks(pairs, ["fold"], {"importance": "_x", "next_importance": "_y"})
    rho = ranked.groupBy("fold").agg(correlation("_x", "_y").alias("rho"), F.count(F.lit(1)).alias("n")).where(F.col("n") > min_common)
    folds = importances.agg(F.count_distinct("fold").alias("n_folds"))
    return folds.crossJoin(F.broadcast(rho.agg(F.avg("rho").alias("_rho"), F.count("rho").alias("n_pairs")))).select(
        "n_folds", "n_pairs", F.when(F.col("n_folds") < 2, 1.0).otherwise(F.coalesce("_rho", F.lit(0.0))).alias("stability")
    )


def drift_report(table: DataFrame, drift: DataFrame, stability: DataFrame, top: int = 10) -> DataFrame:
    """One row: counts per level, the most drifted features, warnings, last rolling IC and importance status.

    table has one row per feature and drift one row per date, so the list and the last value stay small. Each of the three is written
    once: together in one plan, with table read twice, they were more than a driver of 750 MB could plan.
    """
    table, drift, stability = materialize(table), materialize(drift), materialize(stability)
    psi_part = table.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(F.col("drift_level") == "significant").alias("n_significant"),
        F.count_if(F.col("drift_level") == "moderate").alias("n_moderate"),
    )
    leading = table.orderBy(F.desc("psi"), "feature").limit(top).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct((-F.col("psi")).alias("k"), "feature"))), lambda x: x.feature), ","
        ).alias("top_features")
    )
    drift_part = drift.agg(F.count_if("drift_warning").alias("n_warnings"), F.max_by("rolling_ic", "date").alias("recent_rolling_ic"))
    rho = F.col("stability")
    status = F.when(rho > STABLE, "stable").when(rho > WARNING, "warning").otherwise("critical")
    return psi_part.crossJoin(leading).crossJoin(drift_part).crossJoin(stability.select("stability", status.alias("status")))
