"""Selection of names from scores, and the trades that follow from changing selections."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorframe.operators.ordering import date_sized, first_k

MISSING_SCORE = -999.0


def _best() -> list[Column]:
    return [F.desc("score"), F.col("code")]


def top_k(scores: DataFrame, k: int, date: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The k best scores of every date, or of one date (the newest when the given one has no scores).

    Adds rank and strength; the strength bands are quantiles of the picked scores themselves, at most k rows per date.
    """
    rows = scores.where(F.col("score").isNotNull())
    if date is not None:
        wanted = F.lit(None if date == "latest" else date).cast("date")
        chosen = rows.agg(F.coalesce(F.max(F.when(F.col("date") == wanted, F.col("date"))), F.max("date")).alias("date"))
        rows = rows.join(F.broadcast(chosen), "date", "left_semi")
    picked = first_k(rows, [*by, "date"], _best(), k)
    day = Window.partitionBy(*by, "date")
    strong, medium = F.percentile("score", F.lit(0.8)).over(day), F.percentile("score", F.lit(0.5)).over(day)
    strength = (
        F.when(F.col("score") >= strong, "strong").when(F.col("score") >= medium, "medium").when(F.col("score") > 0, "weak")
        .otherwise("negative")
    )
    return picked.withColumn("strength", strength)


def industry_cap(scores: DataFrame, industry: DataFrame | None, k: int, max_weight: float = 0.25) -> DataFrame:
    """Best k per date with at most max(1, int(k * max_weight)) names of one industry; unknown industry is 'Other'.

    Taking names by rank and skipping full industries equals two nested top-n selections.
    """
    if industry is None:
        return first_k(scores, ["date"], _best(), k)
    cap = max(1, int(k * max_weight))
    known = scores.join(industry, "code", "left").withColumn("industry", F.coalesce("industry", F.lit("Other")))
    return first_k(first_k(known, ["date", "industry"], _best(), cap, "industry_rank"), ["date"], _best(), k)


def liquid(scores: DataFrame, volumes: DataFrame, k: int, account: float = 1e8, max_pct: float = 0.05) -> DataFrame:
    """Drop names whose equal-weight position exceeds max_pct of their average traded amount; unknown amounts pass."""
    known = scores.join(volumes.select("code", F.col("adv").alias("_adv")), "code", "left")
    heavy = (F.col("_adv") > 0) & (F.lit(account / k) / F.nullif(F.col("_adv"), F.lit(0.0)) > max_pct)
    return known.where(~F.coalesce(heavy, F.lit(False))).drop("_adv")


def industry_liquidity(
    scores: DataFrame, industry: DataFrame | None, volumes: DataFrame, k: int, max_weight: float = 0.25, account: float = 1e8,
    max_pct: float = 0.05,
) -> DataFrame:
    """industry_cap after liquid, with weight 1/k. Without an industry map: plain top k, weight one over their number."""
    if industry is None:
        picked = first_k(scores, ["date"], _best(), k)
        return picked.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("date")))
    return industry_cap(liquid(scores, volumes, k, account, max_pct), industry, k, max_weight).withColumn("weight", F.lit(1.0 / k))


def date_positions(df: DataFrame) -> DataFrame:
    """date, idx over the dates that occur; one row per date."""
    return df.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("idx"))


def rebalance_trades(targets: DataFrame, keep: bool = False) -> DataFrame:
    """BUY and SELL rows of a full rebalance into each date's targets (date, code, score).

    A name is bought when it was not a target one date earlier and sold on the first date it is no longer one. Each
    name's target dates decide this alone, so no set is compared with another. keep adds a KEEP row for every target.
    """
    dates = date_positions(targets)
    indexed = targets.select("date", "code").join(date_sized(dates), "date")
    mine = Window.partitionBy("code").orderBy("idx")
    marked = indexed.withColumns({"_before": F.lag("idx").over(mine), "_after": F.lead("idx").over(mine)})
    entering = F.col("_before").isNull() | (F.col("_before") < F.col("idx") - 1)
    leaving = F.col("_after").isNull() | (F.col("_after") > F.col("idx") + 1)

    def event(at: Column, action: str, happens: Column) -> Column:
        return F.struct(at.alias("idx"), F.when(happens, action).alias("action"))

    events = [event(F.col("idx"), "BUY", entering), event(F.col("idx") + 1, "SELL", leaving)]
    if keep:
        events.append(event(F.col("idx"), "KEEP", F.lit(True)))
    moves = marked.select("code", F.inline(F.array(*events))).where(F.col("action").isNotNull())
    return moves.join(date_sized(dates), "idx").select("date", "code", "action")


def position_values(targets: DataFrame, returns: DataFrame | None = None, initial: float = 1e8) -> DataFrame:
    """Equal weights and amounts per target: portfolio value over the number held.

    The value follows the compounded returns (date, return) where they exist and stays at the initial cash elsewhere.
    """
    held = targets.withColumn("n_hold", F.count(F.lit(1)).over(Window.partitionBy("date")))
    if returns is None:
        out = held.withColumn("_value", F.lit(float(initial)))
    else:
        growth = F.exp(F.sum(F.log1p("return")).over(Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
        values = returns.select("date", (growth * initial).alias("_value"))  # one row per date
        out = held.join(date_sized(values), "date", "left").withColumn("_value", F.coalesce("_value", F.lit(float(initial))))
    return out.withColumns({"weight": 1 / F.col("n_hold"), "position_value": F.col("_value") / F.col("n_hold")}).drop("_value")


def trade_amounts(trades: DataFrame, positions: DataFrame) -> DataFrame:
    """trades (date, code, action) with amount: what is bought is the position of that date, what is sold the one of the date before.

    positions: (date, code, position_value), one row per held name and date, as `position_values` gives them. KEEP rows carry their position.
    """
    dates = date_positions(positions)
    held = positions.select("date", "code", "position_value").join(date_sized(dates), "date").select("idx", "code", F.col("position_value").alias("amount"))
    at = trades.join(date_sized(dates), "date").withColumn("idx", F.col("idx") - (F.col("action") == "SELL").cast("int"))
    return at.join(held, ["idx", "code"], "left").select("date", "code", "action", "amount")


def cap_buys(
    trades: DataFrame, scores: DataFrame, industry: DataFrame | None, k: int, max_weight: float = 0.25
) -> DataFrame:
    """trades with at most max(1, int(k * max_weight)) BUY rows of one industry per date, best scores first; all other rows stay.

    The cap is relative to the k names held, and sees the buys of a date only. Unknown industry is 'Other'; a name without a score comes last.
    """
    if industry is None:
        return trades
    buys = trades.where(F.col("action") == "BUY").join(scores.select("date", "code", "score"), ["date", "code"], "left").join(industry, "code", "left")
    known = buys.withColumn("industry", F.coalesce("industry", F.lit("Other")))
    order = [F.desc_nulls_last("score"), F.col("code")]
    kept = first_k(known, ["date", "industry"], order, max(1, int(k * max_weight)), "_rank")
    return kept.select(*trades.columns).unionByName(trades.where(F.col("action") != "BUY"))


def trade_summary(trades: DataFrame, amount: str = "amount", by: Sequence[str] = ()) -> DataFrame:
    return trades.groupBy(*by, "action").agg(F.count(F.lit(1)).alias("n_trades"), F.sum(amount).alias("total_amount"))


HOLDING_SCHEMA = "strategy string, date date, code {code}, action string, score double, is_new boolean"


def dropout_holdings(scores: DataFrame, strategies: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Top-k holdings that change by at most n_drop names a date, for several (name, k, n_drop) at once.

    Each date: held names outside the top k are sold, lowest score first, at most n_drop of them (a name without a
    score counts as -999); as many new top-k names are bought, best score first. Rows: action BUY, SELL and HOLD.

    The order of dates is inherent, so one task walks a strategy. It sees only top-k rows and later rows of names that
    were once in the top k (at most dates * dates * k rows, independent of the panel size), reads them as a sorted
    stream of Arrow batches, and keeps nothing but the k held names.
    """
    spark = scores.sparkSession
    grid = spark.createDataFrame(list(strategies), "strategy string, k int, n_drop int")
    k_max = max(k for _, k, _ in strategies)
    rows = scores.where(F.col("score").isNotNull()).select("date", "code", "score")
    ranked = first_k(rows, ["date"], _best(), k_max)
    targets = ranked.crossJoin(F.broadcast(grid)).where(F.col("rank") <= F.col("k"))  # grid: one row per strategy
    entered = targets.groupBy("strategy", "code").agg(F.min("date").alias("_first"))
    later = rows.join(entered, "code").where(F.col("date") >= F.col("_first")).select("strategy", "date", "code", "score")
    tape = later.join(targets.select("strategy", "date", "code", "rank"), ["strategy", "date", "code"], "left").join(
        F.broadcast(grid), "strategy"
    )
    code_type = scores.schema["code"].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, set] = {}
        waiting = None
        for batch in batches:
            batch = batch if waiting is None else pd.concat([waiting, batch])
            last = (batch["strategy"].iloc[-1], batch["date"].iloc[-1])
            unfinished = (batch["strategy"] == last[0]) & (batch["date"] == last[1])
            waiting = batch[unfinished]
            done = batch[~unfinished]
            if len(done):
                yield _step_dates(done, held)
        if waiting is not None and len(waiting):
            yield _step_dates(waiting, held)

    ordered = tape.repartition("strategy").sortWithinPartitions("strategy", "date", "code")
    return ordered.mapInPandas(walk, HOLDING_SCHEMA.format(code=code_type))


def _step_dates(rows: pd.DataFrame, held: dict[str, set]) -> pd.DataFrame:
    """Advance the held sets over complete dates; held is updated in place."""
    out = []
    for (strategy, date), day in rows.groupby(["strategy", "date"], sort=True):
        score = dict(zip(day["code"], day["score"]))
        target = day[day["rank"].notna()].sort_values("rank")["code"].tolist()
        before = held.get(strategy)
        if before is None:
            sells, buys = [], target
        else:
            outside = sorted((score.get(c, MISSING_SCORE), c) for c in before.difference(target))
            sells = [c for _, c in outside[: int(day["n_drop"].iloc[0])]]
            buys = [c for c in target if c not in before][: len(sells)]
        now = (before or set()).difference(sells).union(buys)
        held[strategy] = now
        out += [(strategy, date, c, "SELL", score.get(c), False) for c in sells]
        out += [(strategy, date, c, "BUY", score.get(c), True) for c in buys]
        out += [(strategy, date, c, "HOLD", score.get(c), c in buys) for c in sorted(now)]
    frame = pd.DataFrame(out, columns=["strategy", "date", "code", "action", "score", "is_new"])
    return frame.astype({"score": "float64"})
