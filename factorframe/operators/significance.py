"""Autocorrelation-robust tests, normal tail probabilities and multiple-testing control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorframe.operators.ordering import group_positions, match

# Abramowitz-Stegun 7.1.26 coefficients of the error function (absolute error below 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

SIGNIFICANT_T = 2.0
# floor(n ** 0.25) for any daily series within a century stays below this.
DEFAULT_LAG_BOUND = 14


def normal_cdf(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(ERF_P) * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def two_sided_p(t: str | Column) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.lit(2.0) * (1 - normal_cdf(F.abs(t)))


def newey_west(
    series: DataFrame,
    value: str,
    by: list[str],
    order: str = "date",
    max_lags: int | str | None = None,
    lag_bound: int | None = None,
) -> DataFrame:
    """Bartlett-kernel mean test of many series at once.

    max_lags: a number, a column of per-series lags, or None for floor(n ** 0.25). Lags are clamped to [1, n-1].
    lag_bound is the most lags a series may want (else 60 for a column, 14 for None: enough for 50 000 rows); a series that
    wants more raises an error.
    One window pass carries every lag, one aggregate sums them. A series has one row per date, so a window partition
    is bounded by the calendar.
    """
    if isinstance(max_lags, int):
        bound = max(1, max_lags)
    elif max_lags is None:
        bound = lag_bound or DEFAULT_LAG_BOUND
    else:
        bound = lag_bound or 60
    keys = list(by)
    partition = keys or [F.lit(0)]
    rows = series.where(F.col(value).isNotNull())
    whole = Window.partitionBy(*partition)
    ordered = whole.orderBy(order)
    lag_column = [max_lags] if isinstance(max_lags, str) else []
    centred = rows.select(*keys, order, *lag_column, F.col(value).alias("_x"), (F.col(value) - F.avg(value).over(whole)).alias("_e"))
    shifted = centred.select(
        *keys, *lag_column, "_x", "_e", *[F.lag("_e", lag).over(ordered).alias(f"_e{lag}") for lag in range(1, bound + 1)]
    )
    sums = shifted.groupBy(*keys).agg(
        F.count("_x").alias("n_samples"),
        F.avg("_x").alias("mean"),
        F.stddev_samp("_x").alias("std"),
        F.avg((F.col("_x") > 0).cast("double")).alias("positive_ratio"),
        F.sum(F.col("_e") * F.col("_e")).alias("_s0"),
        F.array(
            *[F.coalesce(F.sum(F.col("_e") * F.col(f"_e{lag}")), F.lit(0.0)) for lag in range(1, bound + 1)]
        ).alias("_s"),
        *[F.max(c).alias("_lags") for c in lag_column],
    )
    n = F.col("n_samples")
    wanted = F.col("_lags") if lag_column else F.lit(max_lags) if max_lags is not None else F.floor(F.pow(n, F.lit(0.25)))
    lags = F.greatest(F.lit(1), F.least(wanted, n - 1)).cast("int")
    lags = F.when(lags > bound, F.raise_error(F.lit(f"newey_west: a series wants more than {bound} lags; pass lag_bound"))).otherwise(lags)
    # Bartlett weights vanish beyond the wanted lag, so the unused sums drop out
    weighted = F.transform("_s", lambda s, i: 2 * s * F.greatest(F.lit(0.0), 1 - (i + 1) / (F.col("lags") + 1)))
    variance = F.col("_s0") + F.aggregate(weighted, F.lit(0.0), lambda total, s: total + s)
    naive = F.when(F.col("std") > 0, F.col("std") / F.sqrt(n))
    out = (
        sums.withColumn("lags", lags)
        .withColumn("nw_se", F.when(n >= 2, F.sqrt(F.greatest(variance / n, F.lit(0.0)) / n)).otherwise(0.0))
        .withColumn("t_naive", F.coalesce(F.col("mean") / naive, F.lit(0.0)))
        .withColumn("t_nw", F.when(F.col("nw_se") > 0, F.try_divide("mean", "nw_se")).otherwise(0.0))
    )
    return out.select(
        *keys,
        "n_samples",
        "mean",
        "std",
        "positive_ratio",
        "lags",
        "nw_se",
        "t_naive",
        "t_nw",
        two_sided_p("t_naive").alias("p_naive"),
        two_sided_p("t_nw").alias("p_nw"),
        (F.abs("t_nw") > SIGNIFICANT_T).alias("significant"),
    )


def _with_count(tests: DataFrame, p: str, by: list[str] | None) -> DataFrame:
    """Tests with a p value, and the size of their family; counted by a partial aggregate, whatever the family holds."""
    rows, keys = tests.where(F.col(p).isNotNull()), list(by or [])
    if not keys:
        return rows.crossJoin(F.broadcast(rows.agg(F.count(p).alias("_m"))))  # one row
    return match(rows, rows.groupBy(*keys).agg(F.count(p).alias("_m")), keys)


def bonferroni(tests: DataFrame, p: str = "p", alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Adjusted p values within each family of tests (a family holds one row per tried configuration)."""
    adjusted = F.least(F.col(p) * F.col("_m"), F.lit(1.0))
    return _with_count(tests, p, by).select(
        *tests.columns, adjusted.alias("p_adjusted"), (F.lit(alpha) / F.col("_m")).alias("threshold"), (adjusted < alpha).alias("significant")
    )


def benjamini_hochberg(
    tests: DataFrame, p: str = "p", tie: str = "id", alpha: float = 0.05, by: list[str] | None = None, run: int = 1 << 18
) -> DataFrame:
    """Step-up adjusted p values: the running minimum of p * m / rank from the largest p down.

    Ranks come from group_positions, and the minimum is taken inside runs of neighbouring ranks and then over the runs
    behind, so no window sees a whole family.
    """
    keys = list(by or [])
    placed = _with_count(tests, p, by).withColumn("_order", F.struct(F.col(p), F.col(tie)))
    ranks = group_positions(placed.select(*keys, "_order"), keys, "_order").select(*keys, "_order", (F.col("before") + 1).alias("_rank"))
    scaled = match(placed, ranks, [*keys, "_order"]).withColumns({
        "_scaled": F.col(p) * F.col("_m") / F.col("_rank"), "_run": F.floor((F.col("_rank") - 1) / run)})
    family = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_run")
    behind = scaled.groupBy(*keys, "_run").agg(F.min("_scaled").alias("_least")).select(
        *keys, "_run", F.min("_least").over(family.rowsBetween(1, Window.unboundedFollowing)).alias("_behind"))
    inside = Window.partitionBy(*keys, "_run").orderBy("_rank").rowsBetween(0, Window.unboundedFollowing)
    adjusted = F.least(F.min("_scaled").over(inside), "_behind", F.lit(1.0))
    return match(scaled, behind, [*keys, "_run"]).withColumn("p_adjusted", adjusted).select(
        *tests.columns, "p_adjusted", F.lit(alpha).alias("threshold"), (F.col("p_adjusted") < alpha).alias("significant"))


def paired_test(
    ic_a: DataFrame, ic_b: DataFrame, name_a: str = "a", name_b: str = "b", min_common: int = 20, min_days: int = 5
) -> DataFrame:
    """Compare two IC series (date, ic): robust test of the daily difference, winner and whether it is decided.

    The difference is tested only when more than min_common dates are shared; the winner is the larger mean.
    """
    both = ic_a.select("date", F.col("ic").alias("_a")).join(ic_b.select("date", F.col("ic").alias("_b")), "date", "full")
    common = both.where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    test = newey_west(common.withColumn("_d", F.col("_a") - F.col("_b")), "_d", []).select(
        F.col("n_samples").alias("n_common"),
        F.when(F.col("n_samples") > min_common, F.col("p_nw")).alias("diff_p"),
        F.when(F.col("n_samples") > min_common, F.col("significant")).alias("diff_significant"),
    )
    means = both.agg(F.avg("_a").alias("mean_a"), F.avg("_b").alias("mean_b"))
    winner = F.when(F.col("mean_b").isNull() | (F.col("mean_a") > F.col("mean_b")), F.lit(name_a)).otherwise(name_b)
    return means.crossJoin(F.broadcast(test)).select(
        "n_common",
        "mean_a",
        "mean_b",
        "diff_p",
        "diff_significant",
        winner.alias("winner"),
        F.when(F.col("diff_significant"), "significant").otherwise("not significant").alias("verdict"),
    )
