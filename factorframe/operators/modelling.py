"""Model training on Spark ML, and importance tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorframe.operators.ic import icir_summary, rank_ic
from factorframe.session import materialize


def cumulative_share(df: DataFrame, value: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """Add share (running share of the total, largest first) and place. For tables of one row per feature or group."""
    whole = Window.partitionBy(*(list(by) or [F.lit(0)]))
    ordered = whole.orderBy(F.desc(value), tie)
    running = F.sum(value).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return df.select("*", F.try_divide(running, F.sum(value).over(whole)).alias("share"), F.row_number().over(ordered).alias("place"))


def _estimator(kind: str, params: Mapping, label: str):
    if kind == "linear":
        return LinearRegression(labelCol=label, featuresCol="_features", **params)
    if kind == "boosting":
        return GBTRegressor(labelCol=label, featuresCol="_features", seed=7, **params)
    raise ValueError(f"unknown model kind {kind!r}")


def fit_model(train: DataFrame, features: Sequence[str], label: str = "label", kind: str = "linear", **params):
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip")
    return Pipeline(stages=[assembler, _estimator(kind, params, label)]).fit(train.where(F.col(label).isNotNull()))


def score_rows(model, rows: DataFrame, keep: Sequence[str] = ("code", "date", "label")) -> DataFrame:
    return model.transform(rows).select(*keep, F.col("prediction").alias("score"))


def train_score(
    rows: DataFrame, features: Sequence[str], train, test, label: str = "label", kind: str = "linear", **params
) -> DataFrame:
    """Fit on the rows where train holds and score the rows where test holds: code, date, label, score."""
    return score_rows(fit_model(rows.where(train), features, label, kind, **params), rows.where(test), ("code", "date", label))


def feature_importance(model, features: Sequence[str], spark) -> DataFrame:
    """feature, importance: split gains of a boosted model, absolute coefficients of a linear one."""
    stage = model.stages[-1]
    weights = stage.featureImportances.toArray() if hasattr(stage, "featureImportances") else abs(stage.coefficients.toArray())
    return spark.createDataFrame([(f, float(w)) for f, w in zip(features, weights)], "feature string, importance double")


def grid_search(
    rows: DataFrame, features: Sequence[str], train, valid, grid: Sequence[Mapping], label: str = "label"
) -> DataFrame:
    """Mean and ratio of the validation rank IC per parameter set; test rows never take part.

    Each entry holds kind and its parameters. Fits run one after the other, each distributed, from rows written once; linear.ridge_search
    judges linear models from one pass.
    """
    train_rows, valid_rows = materialize(rows.where(train)), materialize(rows.where(valid))
    scored = None
    for i, entry in enumerate(grid):
        params = dict(entry)
        model = fit_model(train_rows, features, label, params.pop("kind", "linear"), **params)
        part = score_rows(model, valid_rows, ("date", label)).withColumn("trial", F.lit(i))
        scored = part if scored is None else scored.unionByName(part)
    ic = rank_ic(scored, ["trial", "date"], label=label)
    names = F.create_map(*[F.lit(x) for i, e in enumerate(grid) for x in (i, str(dict(sorted(e.items()))))])
    return icir_summary(ic, ["trial"]).withColumn("params", names[F.col("trial")]).withColumn(
        "best", F.col("ic_mean") == F.max("ic_mean").over(Window.partitionBy(F.lit(0)))
    )


def linear_contributions(
    rows: DataFrame, features: Sequence[str], coefficients: DataFrame, keep: Sequence[str] = ("code", "date")
) -> DataFrame:
    """Exact additive contributions of a linear score: coefficient * (value - mean value).

    coefficients: (feature, coefficient). Output: keep..., feature, value, contribution.
    """
    long = rows.select(*keep, *features).unpivot(list(keep), list(features), "feature", "value").where(F.col("value").isNotNull())
    means = long.groupBy("feature").agg(F.avg("value").alias("_mean")).join(coefficients, "feature")
    return long.join(F.broadcast(means), "feature").select(  # one row per feature
        *keep, "feature", "value", (F.col("coefficient") * (F.col("value") - F.col("_mean"))).alias("contribution")
    )


def contribution_importance(contributions: DataFrame) -> DataFrame:
    """feature, mean_abs, std (population), place, share (cumulative)."""
    stats = contributions.groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs"), F.stddev_pop("contribution").alias("std")
    )
    return cumulative_share(stats, "mean_abs", "feature")


def features_for_share(importance: DataFrame, share: float = 0.9) -> DataFrame:
    """Number of leading features needed to reach a share of the total."""
    return importance.agg((F.count_if(F.col("share") < share) + 1).alias("n_features"))


def explain_row(contributions: DataFrame, code, date: str) -> DataFrame:
    """Contributions of one (code, date), largest magnitude first."""
    row = contributions.where((F.col("code") == F.lit(code)) & (F.col("date") == F.lit(date).cast("date")))
    return row.select("feature", "value", "contribution").orderBy(F.desc(F.abs("contribution")), "feature")


def univariate_coefficients(rows: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Slope of the label on each feature alone: feature, coefficient."""
    long = rows.select(label, *features).unpivot([label], list(features), "feature", "value")
    return long.groupBy("feature").agg(F.regr_slope(label, "value").alias("coefficient"))


