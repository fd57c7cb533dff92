"""Experiment log rules, variant comparison and parameter sweeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorframe.operators.ic import icir_summary, rank_ics
from factorframe.operators.ordering import first_k
from factorframe.operators.significance import benjamini_hochberg, bonferroni

EXPLORATION, CONFIRMATION = "exploration", "confirmation"


def experiment_counts(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return records.groupBy(*by).agg(
        F.count_if(F.col("phase") == EXPLORATION).alias("n_exploration"), F.count_if(F.col("phase") == CONFIRMATION).alias("n_confirmation")
    )


def protocol_check(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per project: at most one confirmation, and its test range apart from every exploration range.

    records: by..., phase, start_date, end_date. Ranges are compared only for projects with exactly one confirmation,
    so each exploration row meets at most one row of the other side.
    """
    keys = list(by)
    counts = experiment_counts(records, keys)
    single = counts.where(F.col("n_confirmation") == 1).select(*keys)
    confirmed = records.where(F.col("phase") == CONFIRMATION).join(single, keys, "left_semi").select(
        *keys, F.col("start_date").alias("_s"), F.col("end_date").alias("_e")
    )
    explored = records.where((F.col("phase") == EXPLORATION) & F.col("start_date").isNotNull() & F.col("end_date").isNotNull())
    overlaps = (
        explored.join(confirmed, keys)
        .where((F.col("start_date") <= F.col("_e")) & (F.col("_s") <= F.col("end_date")))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_overlaps"))
    )
    out = counts.join(overlaps, keys, "left").withColumn("n_overlaps", F.coalesce("n_overlaps", F.lit(0)))
    many = F.col("n_confirmation") > 1
    return out.withColumns(
        {
            "ok": ~many & (F.col("n_overlaps") == 0),
            "message": F.when(many, "more than one confirmation").when(F.col("n_overlaps") > 0, "test ranges overlap").otherwise("ok"),
        }
    )


def corrected_significance(records: DataFrame, method: str = "fdr_bh", alpha: float = 0.05, metric: str = "nw_p_value") -> DataFrame:
    """Adjusted p values of the exploration records that carry one."""
    tests = records.where(F.col("phase") == EXPLORATION).select("description", F.col("metrics")[metric].alias("p"))
    if method == "bonferroni":
        return bonferroni(tests, "p", alpha)
    if method == "fdr_bh":
        return benjamini_hochberg(tests, "p", "description", alpha)
    raise ValueError(f"unknown method {method!r}")


def compare_variants(df: DataFrame, variants: Sequence[str], label: str = "label", max_lags: int | None = None) -> DataFrame:
    """IC summary of every variant (a score column), with the one of largest ICIR marked."""
    daily = rank_ics(df, ["date"], {v: F.col(v) for v in variants}, label, name="variant").where(F.col("ic").isNotNull())
    table = icir_summary(daily, ["variant"], max_lags)
    best = F.max_by("variant", "icir").over(Window.partitionBy(F.lit(0)))  # one row per variant
    return table.withColumn("winner", F.col("variant") == best)


def compare_experiments(df: DataFrame, experiments: Mapping[str, Sequence[str]], label: str = "label", max_lags: int | None = None) -> DataFrame:
    """One table of several experiments, each a set of variants (score columns): experiment, the IC summary of each variant, and its winner.

    A variant that several experiments share is ranked once. The winner has the largest ICIR of its experiment; ties go to the first name.
    """
    variants = sorted({v for group in experiments.values() for v in group})
    daily = rank_ics(df, ["date"], {v: F.col(v) for v in variants}, label, name="variant").where(F.col("ic").isNotNull())
    table = icir_summary(daily, ["variant"], max_lags)
    members = [(e, v) for e, group in experiments.items() for v in group]
    both = table.join(F.broadcast(df.sparkSession.createDataFrame(members, "experiment string, variant string")), "variant")  # a row per member
    place = F.row_number().over(Window.partitionBy("experiment").orderBy(F.desc_nulls_last("icir"), "variant"))
    return both.withColumn("winner", place == 1).select("experiment", *table.columns, "winner")


def param_sweep(rows: DataFrame, parameter: str, values: Sequence, metric: Column, name: str = "metric") -> DataFrame:
    """Metric per parameter value and the best value. rows carries the parameter as a column."""
    grid = rows.where(F.col(parameter).isin(list(values))).groupBy(parameter).agg(metric.alias(name))
    top = F.max(name).over(Window.partitionBy(F.lit(0)))
    return grid.withColumn("best", F.col(name) == top)


def sweep_top_k(scores: DataFrame, returns: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Mean return of the k best names for each k, from one selection of the largest k. returns: (date, code, ret)."""
    largest = first_k(scores, ["date"], [F.desc("score"), F.col("code")], max(ks))
    grid = F.explode(F.array(*[F.lit(k) for k in ks]))
    cells = largest.withColumn("k", grid).where(F.col("rank") <= F.col("k")).join(returns, ["date", "code"])
    daily = cells.groupBy("k", "date").agg(F.avg("ret").alias("ret"))
    return param_sweep(daily, "k", ks, F.avg("ret"), "mean_return")




def sweep_windows(panel: DataFrame, column: str, windows: Sequence[int], label: Column, max_lags: int | None = None) -> DataFrame:
    """IC summary of the deviation from the trailing mean, -(x / mean of n rows - 1), for each window length n, the best ICIR marked.

    All means come from one running sum per code: the sum up to a row less the sum n rows before. Sums are of distances from the
    code's own level, so long series keep their digits. One exchange serves every window.
    """
    ordered = Window.partitionBy("code").orderBy("date")
    whole = Window.partitionBy("code")
    x = F.col(column)
    centred = panel.select("code", "date", x.alias("_x"), label.alias("label"), F.avg(x).over(whole).alias("_level"))
    upto = centred.select(
        "*", F.sum(F.col("_x") - F.col("_level")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"),
        F.count("_x").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("_count"))

    def score(n: int) -> Column:
        before, known = F.lag("_sum", n, 0.0).over(ordered), F.col("_count") - F.lag("_count", n, 0).over(ordered)
        mean = (F.col("_sum") - F.coalesce(before, F.lit(0.0))) / n + F.col("_level")
        return F.when(known == n, -(F.col("_x") / mean - 1))

    wide = upto.select("date", "label", *[score(n).alias(str(n)) for n in windows]).where(F.col("label").isNotNull())
    daily = rank_ics(wide, ["date"], {str(n): F.col(f"`{n}`") for n in windows}, name="_length").where(F.col("ic").isNotNull())
    table = icir_summary(daily.select(F.col("_length").cast("int").alias("length"), "date", "ic"), ["length"], max_lags)
    best = F.max_by("length", "icir").over(Window.partitionBy(F.lit(0)))  # one row per window
    return table.withColumn("best", F.col("length") == best)
