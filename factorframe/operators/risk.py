"""Style and industry exposure, return attribution and capacity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorframe.functions import rolling as R
from factorframe.functions.factors import momentum_12_1
from factorframe.operators.linear import moments, solve, systems
from factorframe.operators.significance import newey_west

STYLES = ("size", "value", "momentum", "volatility", "quality")
MIN_NAMES = 10
MAX_ACTIVE_STD = 0.5
MAX_ACTIVE_WEIGHT = 0.25
MAX_USAGE = 0.05
ALPHA_DRIVEN, MIXED = 0.7, 0.3


def style_factors(
    panel: DataFrame, fundamentals: DataFrame, size_window: int = 60, vol_window: int = 60, skip: int = 21, span: int = 252,
    keep: Sequence[str] = (),
) -> DataFrame:
    """date, code, the five styles and the panel columns of keep. fundamentals: (code, date, value, quality), joined on both keys."""
    priced = panel.withColumn("ret", R.pct_change("close", 1)).select(
        "code",
        "date",
        F.log(R.mean("amount", size_window)).alias("size"),
        momentum_12_1(skip, span).alias("momentum"),
        R.std("ret", vol_window).alias("volatility"),
        *keep,
    )
    return priced.join(fundamentals.select("code", "date", "value", "quality"), ["code", "date"], "left").select("date", "code", *STYLES, *keep)


def style_exposure(
    weights: DataFrame, factors: DataFrame, styles: Sequence[str] = STYLES, benchmark: DataFrame | None = None,
    min_names: int = MIN_NAMES,
) -> DataFrame:
    """Portfolio and benchmark exposure per date and style, in cross-sectional standard deviations of the held names.

    weights and benchmark: (date, code, weight). Without a benchmark its exposure is the plain mean. Sums are enough:
    the weighted mean of z follows from the weighted mean of the factor, so rows are read once and never normalised.
    """
    held = weights.join(factors, ["date", "code"])
    if benchmark is not None:
        held = held.join(benchmark.select("date", "code", F.col("weight").alias("_bw")), ["date", "code"], "left")
    else:
        held = held.withColumn("_bw", F.lit(None).cast("double"))
    long = held.unpivot(["date", "weight", "_bw"], list(styles), "style", "x")
    known = F.col("x").isNotNull()
    stats = long.groupBy("date", "style").agg(
        F.sum("weight").alias("_w"),
        F.sum("_bw").alias("_b"),
        F.sum(F.when(known, F.col("weight"))).alias("_wk"),
        F.sum(F.when(known, F.col("_bw"))).alias("_bk"),
        F.sum(F.col("weight") * F.col("x")).alias("_wx"),
        F.sum(F.col("_bw") * F.col("x")).alias("_bx"),
        F.avg("x").alias("factor_mean"),
        F.stddev_samp("x").alias("factor_std"),
        F.count("x").alias("n"),
    ).where(F.col("n") >= min_names)
    flat = F.col("factor_std") < 1e-12
    mean, deviation = F.col("factor_mean"), F.nullif(F.col("factor_std"), F.lit(0.0))

    def weighted(total: str, inside: str, product: str):
        z = F.try_divide(F.col(product) - mean * F.col(inside), F.col(total) * deviation)
        return F.when(flat, 0.0).otherwise(z)

    portfolio = weighted("_w", "_wk", "_wx")
    reference = F.coalesce(weighted("_b", "_bk", "_bx"), F.lit(0.0))  # the plain mean of z is zero
    return stats.select(
        "date", "style", portfolio.alias("portfolio_exposure"), reference.alias("benchmark_exposure"),
        (portfolio - reference).alias("active_exposure"), "factor_mean", "factor_std",
    )


def check_constraint(exposures: DataFrame, active: str, limit: float, by: str = "date") -> DataFrame:
    """Add constraint_ok, message, and all_ok over each date (a few rows per date)."""
    ok = F.abs(active) <= limit
    text = F.when(ok, "ok").otherwise(F.format_string(f"|%s| = %.2f over {limit:g}", F.lit(active), F.abs(active)))
    return exposures.withColumns({"constraint_ok": ok, "message": text, "all_ok": F.bool_and(ok).over(Window.partitionBy(by))})


def style_constraint(exposures: DataFrame, limit: float = MAX_ACTIVE_STD) -> DataFrame:
    return check_constraint(exposures, "active_exposure", limit)


def industry_exposure(weights: DataFrame, industry: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Normalised industry weights per date against a benchmark, or against equal industry weights."""

    def by_industry(rows: DataFrame, name: str) -> DataFrame:
        totals = rows.join(industry, "code").groupBy("date", "industry").agg(F.sum("weight").alias("_w"))
        share = F.try_divide(F.col("_w"), F.sum("_w").over(Window.partitionBy("date")))
        return totals.select("date", "industry", share.alias(name))

    names = industry.select("industry").distinct()
    dates = weights.select("date").distinct()
    grid = dates.crossJoin(F.broadcast(names))  # dates x industries
    held = grid.join(by_industry(weights, "portfolio_weight"), ["date", "industry"], "left")
    if benchmark is None:
        count = names.agg((1 / F.count(F.lit(1))).alias("benchmark_weight"))
        both = held.crossJoin(F.broadcast(count))
    else:
        both = held.join(by_industry(benchmark, "benchmark_weight"), ["date", "industry"], "left")
    p, b = F.coalesce("portfolio_weight", F.lit(0.0)), F.coalesce("benchmark_weight", F.lit(0.0))
    return both.select("date", "industry", p.alias("portfolio_weight"), b.alias("benchmark_weight"), (p - b).alias("active_weight"))


def industry_constraint(exposures: DataFrame, limit: float = MAX_ACTIVE_WEIGHT) -> DataFrame:
    return check_constraint(exposures, "active_weight", limit)


def fama_macbeth(rows: DataFrame, factors: Sequence[str], ret: str = "ret", min_names: int = MIN_NAMES) -> DataFrame:
    """Daily cross-sectional OLS with intercept: date, factor, factor_return, n.

    Spark sums the centred products of each date and solves its system by elimination. A factor that is flat on a date, or a
    combination of factors before it in the list, cannot be told apart there: its return is null and the others are solved without it.
    """
    need = max(min_names, 5 * len(factors))
    daily = moments(rows, ["date"], [*factors, ret]).where(F.col("n") >= need)
    solved = solve(systems(daily, ["date"], len(factors)), len(factors))
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col("coefficients")[i].alias("factor_return")) for i, f in enumerate(factors)])
    return solved.select("date", "n", F.inline(pairs))


def factor_premium(factor_returns: DataFrame, max_lags: int | None = None) -> DataFrame:
    return newey_west(factor_returns, "factor_return", ["factor"], max_lags=max_lags).select(
        "factor", "n_samples", F.col("mean").alias("premium"), "nw_se", "t_nw", "p_nw", "significant"
    )


def decompose_excess(report: DataFrame, exposures: DataFrame, factor_returns: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Per date: excess return, contribution of each factor, their total and the remaining alpha.

    report: (date, return, bench); exposures: (date, factor, exposure); factor_returns: (date, factor, factor_return).
    """
    parts = exposures.join(factor_returns, ["date", "factor"]).withColumn("_c", F.col("exposure") * F.col("factor_return"))
    wide = parts.groupBy("date").pivot("factor", list(factors)).agg(F.sum("_c"))
    total = F.lit(0.0)
    for f in factors:
        total = total + F.coalesce(F.col(f), F.lit(0.0))
    excess = F.col("return") - F.col("bench")
    return report.join(wide, "date").select(
        "date", excess.alias("total_excess"), *[F.col(f).alias(f"style_{f}") for f in factors], total.alias("style_total"),
        (excess - total).alias("alpha"),
    )


def attribution_summary(decomposition: DataFrame, factors: Sequence[str], periods: int = 252, max_lags: int = 20) -> DataFrame:
    """One row: annualised parts, share and class of the alpha, and its robust test."""
    annual = decomposition.agg(
        F.count(F.lit(1)).alias("n_days"),
        *[(F.avg(c) * periods).alias(c) for c in ("total_excess", *[f"style_{f}" for f in factors], "style_total", "alpha")],
    )
    test = newey_west(decomposition, "alpha", [], max_lags=max_lags).select(
        F.when(F.col("n_samples") > 5, F.col("t_nw")).alias("t_nw"), F.when(F.col("n_samples") > 5, F.col("p_nw")).alias("p_nw"),
        F.when(F.col("n_samples") > 5, F.col("significant")).alias("significant"),
    )
    share = F.when(F.abs("total_excess") > 0.001, F.abs(F.try_divide("alpha", "total_excess")))
    driver = (
        F.when(share > ALPHA_DRIVEN, "alpha").when(share > MIXED, "mixed").when(share.isNotNull(), "style").otherwise("no excess")
    )
    return annual.crossJoin(F.broadcast(test)).withColumns({"alpha_share": share, "driver": driver})


def average_amount(panel: DataFrame, window: int = 60, amount: str = "amount") -> DataFrame:
    """Trailing mean traded amount at each code's newest row: code, adv."""
    rolled = panel.select("code", "date", R.mean(amount, window).alias("_adv"))
    return rolled.groupBy("code").agg(F.max_by("_adv", "date").alias("adv"))


def capacity_check(weights: DataFrame, volumes: DataFrame, account: float = 1e8, max_usage: float = MAX_USAGE) -> DataFrame:
    """Share of the average traded amount each position would take; missing amounts count as 1 and fail."""
    joined = weights.join(volumes, "code", "left").withColumn("adv", F.coalesce("adv", F.lit(0.0)))
    position = F.col("weight") * account
    usage = F.when(F.col("adv") <= 0, 1.0).otherwise(F.try_divide(position, "adv"))
    ok = (F.col("adv") > 0) & (usage <= max_usage)
    return joined.select("*", position.alias("position_value"), usage.alias("usage_pct"), ok.alias("acceptable"))


def capacity_passes(checked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return checked.groupBy(*by).agg(F.bool_and("acceptable").alias("all_ok"), F.max("usage_pct").alias("max_usage"))
