"""Joins by position, interval and calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorframe.functions import rolling as R
from factorframe.operators.ordering import date_sized


def lookup(df: DataFrame, dim: DataFrame, on: str | Sequence[str], column: str, default) -> DataFrame:
    """Left join with a default. Catalyst broadcasts the dimension only when its size allows."""
    return df.join(dim, on, "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def calendar_index(df: DataFrame, calendar: DataFrame, date: str = "date") -> DataFrame:
    return df.join(date_sized(calendar.select(F.col("date").alias(date), "idx")), date)


def shift_forward(df: DataFrame, calendar: DataFrame, date: str, n: int, fallback: str) -> DataFrame:
    """Replace date by the n-th calendar date after the first one on or after it.

    Beyond the calendar's end: fallback when the shift runs out, the date itself when no calendar date follows it.
    The range search becomes two equality joins: every day of the calendar's span knows the first trading date on or
    after it. Both tables have one row per day and are broadcast, so df is not shuffled.
    """
    gaps = calendar.select("date", "idx", F.lag("date").over(Window.orderBy("date")).alias("_previous"))
    days = gaps.select(
        F.explode(F.sequence(F.coalesce(F.date_add("_previous", 1), F.col("date")), F.col("date"))).alias("_day"),
        (F.col("idx") + n).alias("_at"),
    )
    targets = calendar.select(F.col("idx").alias("_at"), F.col("date").alias("_target"))
    first = calendar.agg(F.min("date").alias("_first"))  # one row
    placed = df.crossJoin(F.broadcast(first)).withColumn("_day", F.greatest(F.col(date), F.col("_first")))
    found = placed.join(date_sized(days), "_day", "left").join(date_sized(targets), "_at", "left")
    moved = F.when(F.col("_at").isNull(), F.col(date)).otherwise(F.coalesce("_target", fallback))
    return found.withColumn(date, moved).select(*df.columns)


LEVELS = 22  # blocks of up to 2^21 days


def interval_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of closed intervals (id, start_date, end_date) that overlap: left_id, right_id, and the shared range.

    Two intervals overlap when one starts inside the other. An interval is split into at most two aligned blocks of days per
    power of two; a start lies in exactly one block per power, so an equality join on blocks forms each overlapping pair once
    and no other pair, however busy a time is. Starts are sent only to the powers that the other side's intervals have, so a block that
    spans the calendar exists only if some interval does.
    """
    def named(df: DataFrame, side: str) -> DataFrame:
        rows = df.select(F.col("id").alias(f"{side}_id"), F.unix_date("start_date").alias(f"{side}_s"), F.unix_date("end_date").alias(f"{side}_e"))
        return rows.where(F.col(f"{side}_s") <= F.col(f"{side}_e"))

    def blocks(rows: DataFrame, side: str) -> DataFrame:
        """The largest aligned blocks that tile each interval."""
        s, e = F.col(f"{side}_s"), F.col(f"{side}_e")
        parts = []
        for level in range(LEVELS):
            width = 1 << level
            first, last = F.ceil(s / width), F.floor((e + 1) / width) - 1
            for block in (first, last):
                parent = F.floor(block / 2) * 2 * width
                whole = (block * width >= s) & (block * width + (width - 1) <= e)
                top = F.lit(level == LEVELS - 1) | (parent < s) | (parent + (2 * width - 1) > e)
                parts.append(F.when(whole & top, F.struct(F.lit(level).alias("level"), block.cast("long").alias("block"))))
        return rows.withColumn("_at", F.explode(F.array_distinct(F.array_compact(F.array(*parts))))).select("*", "_at.*").drop("_at")

    def starts(rows: DataFrame, side: str, tiles: DataFrame) -> DataFrame:
        levels = F.broadcast(tiles.select("level").distinct())  # at most LEVELS rows
        return rows.crossJoin(levels).withColumn("block", F.expr(f"CAST(shiftright({side}_s, level) AS BIGINT)"))

    a, b = named(left, "left"), named(right, "right")
    tiles_a, tiles_b = blocks(a, "left"), blocks(b, "right")
    inside_left = tiles_a.join(starts(b, "right", tiles_a), ["level", "block"])
    inside_right = tiles_b.join(starts(a, "left", tiles_b), ["level", "block"]).where("left_s > right_s")
    return inside_left.unionByName(inside_right).select(
        "left_id", "right_id", F.date_from_unix_date(F.greatest("left_s", "right_s")).alias("start_date"),
        F.date_from_unix_date(F.least("left_e", "right_e")).alias("end_date"))


def densify(panel: DataFrame, calendar: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per code and calendar date inside the code's own range; gaps are null.

    Only the gaps are generated: each row and the calendar positions up to the code's next row. No grid is joined back.
    """
    indexed = calendar_index(panel.select("code", "date", *columns), calendar).drop("date")
    following = F.lead("idx").over(Window.partitionBy("code").orderBy("idx"))
    spread = indexed.withColumn("_to", F.coalesce(following - 1, F.col("idx"))).withColumn(
        "_at", F.explode(F.sequence("idx", "_to"))
    )
    real = F.col("_at") == F.col("idx")
    dates = calendar.select(F.col("idx").alias("_at"), "date")
    return spread.join(date_sized(dates), "_at").select("code", "date", *[F.when(real, F.col(c)).alias(c) for c in columns], real.alias("traded"))


def later_prices(panel: DataFrame, offsets: dict[str, int], price: str = "open") -> DataFrame:
    """Price so many rows later of the same code, one column per offset."""
    return panel.select("code", "date", *[R.ref(price, -n).alias(name) for name, n in offsets.items()])


def membership(panel: DataFrame, intervals: DataFrame) -> DataFrame:
    """Panel rows inside any of their code's validity intervals. Overlapping intervals do not repeat rows."""
    ranges = intervals.select("code", F.col("start_date").alias("_s"), F.col("end_date").alias("_e"))
    return panel.join(
        ranges, (panel["code"] == ranges["code"]) & (F.col("date") >= F.col("_s")) & (F.col("date") <= F.col("_e")), "left_semi"
    )
