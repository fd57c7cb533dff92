"""Streaming ingestion of bars and ticks.

Every job runs with availableNow for catch-up, or with a processing-time trigger when one is given.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factorframe.operators.quality import ADJUST_EVENT
from factorframe.sources.panel import instruments, trade_calendar
from factorframe.streaming import snapshots


def stream_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def _trigger(writer, interval: str | None):
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


# ---- upsert ----------------------------------------------------------------------------------------------------------


def current_bars(spark: SparkSession, target: str) -> DataFrame | None:
    """The upserted panel as the newest snapshot has it, None before the first row. A folder that cannot be read raises."""
    return snapshots.rows_of(spark, target, snapshots.latest(spark, target))


def upsert_batch(batch: DataFrame, batch_id: int, target: str, order: str = "ingest", writer: str = "upsert") -> None:
    """Merge new bars into the months they touch; per (code, date) the largest ingest mark wins. A replayed batch changes nothing.

    writer names the stream, whose batches are numbered by its checkpoint; several streams may write to one target.
    """
    snapshots.merge(batch, target, writer, batch_id, ["code", "date"], order, "last")


def compact_bars(spark: SparkSession, target: str) -> int:
    """Merge all months that have additions, and return the number of the snapshot."""
    return snapshots.compact(spark, target)["version"]


def refresh_dimensions(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame] | None:
    """Trading calendar (date, idx) and instrument ranges (code, start_date, end_date) of the panel as it stands now."""
    rows = current_bars(spark, target)
    return None if rows is None else (trade_calendar(rows), instruments(rows))


def start_upsert(stream: DataFrame, target: str, checkpoint: str, interval: str | None = None, writer: str = "upsert"):
    out = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: upsert_batch(batch, batch_id, target, writer=writer)
    )
    return _trigger(out, interval).start()


# ---- price jumps with state ------------------------------------------------------------------------------------------

EVENT_SCHEMA = "code {code}, date date, prev_close double, close double, change double, event boolean, version long"
STATE_SCHEMA = T.StructType([
    T.StructField("dates", T.ArrayType(T.DateType())), T.StructField("closes", T.ArrayType(T.DoubleType())), T.StructField("version", T.LongType())])


def _jumps(closes: dict, threshold: float) -> dict:
    """date -> (previous close, close, change, whether it is a jump) of every date but the first."""
    dates = sorted(closes)
    out = {}
    for before, date in zip(dates, dates[1:]):
        change = closes[date] / closes[before] - 1 if closes[before] else float("nan")
        out[date] = (closes[before], closes[date], change, abs(change) > threshold)
    return out


def adjust_events(stream: DataFrame, threshold: float = ADJUST_EVENT, lateness_days: int | None = 30) -> DataFrame:
    """Log of bars whose close moved more than threshold against the previous bar of the code, across batches and whatever their order.

    A late bar changes two moves, its own and the next bar's; jumps that appear or alter are logged, and those that vanish are logged with event
    false, with a version that grows per code. `settled_events` reads the log. State per code are the closes of the last lateness_days
    before its newest bar and the one before them (None: all of its dates); later bars than that are ignored.
    """
    code_type = stream.schema["code"].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dates, values, version = state.get if state.exists else ([], [], 0)
        held = dict(zip(dates, values))
        # one close per date, frame by frame: what is held is bounded by the calendar, whatever the batch repeats
        fresh: dict = {}
        for part in frames:
            part = part.dropna(subset=["close"])
            fresh.update(zip(part["date"], part["close"].astype(float)))
        if lateness_days is not None and held:
            first = max(held) - timedelta(days=lateness_days)
            fresh = {d: x for d, x in fresh.items() if d >= first}
        if not fresh:
            return
        before, after = _jumps(held, threshold), _jumps({**held, **fresh}, threshold)
        rows = [(key[0], d, *now, version + 1) for d, now in after.items() if now != before.get(d) and (now[3] or (d in before and before[d][3]))]
        held.update(fresh)
        order = sorted(held)
        if lateness_days is not None:
            recent = bisect_left(order, order[-1] - timedelta(days=lateness_days))
            order = order[max(0, recent - 1):]
        state.update((order, [held[d] for d in order], version + 1))
        if rows:
            yield pd.DataFrame(rows, columns=["code", "date", "prev_close", "close", "change", "event", "version"])

    return (
        stream.select("code", "date", "close")
        .groupBy("code")
        .applyInPandasWithState(step, EVENT_SCHEMA.format(code=code_type), STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    )


def settled_events(log: DataFrame) -> DataFrame:
    """code, date, prev_close, close, change of the jumps that stand: the newest version of each bar in the log."""
    newest = log.groupBy("code", "date").agg(F.max_by(F.struct("prev_close", "close", "change", "event"), "version").alias("e"))
    return newest.where("e.event").select("code", "date", "e.prev_close", "e.close", "e.change")


# ---- ticks to bars ---------------------------------------------------------------------------------------------------


def utc_instant(wall):
    """Zone-free wall-clock time as an instant that reads the same in UTC, whatever the session zone.

    Watermarks need instants, and day windows are cut at midnight UTC.
    """
    return F.from_utc_timestamp(wall.cast("timestamp"), F.current_timezone())


def utc_wall(instant):
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")


def ohlcv(ticks: DataFrame, width: str = "1 day", slide: str | None = None, watermark: str | None = "1 day") -> DataFrame:
    """Bars per code and window of event time; works on a stream (append mode) and on a static frame.

    ticks: code, ts, seq, price, volume. The first and last price follow (ts, seq). A stream needs ts as an instant; see
    utc_instant for zone-free times.
    """
    rows = ticks.withWatermark("ts", watermark) if watermark and ticks.isStreaming else ticks
    frame = F.window("ts", width, slide) if slide else F.window("ts", width)
    order = F.struct("ts", "seq")
    return rows.groupBy("code", frame.alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_ticks"),
    ).select("code", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume", "n_ticks")


def sliding_ohlcv(ticks: DataFrame, width: str, slide: str, watermark: str = "1 day") -> DataFrame:
    """Bars of overlapping windows on a stream, in append mode, with each tick aggregated once.

    Ticks are aggregated into panes of `slide`, and each window is merged from its panes; width is a multiple of slide. Both steps keep
    state only until the watermark passes, and the second holds a row per pane, however many ticks came.
    """
    order = F.struct("ts", "seq")
    panes = ticks.withWatermark("ts", watermark).groupBy("code", F.window("ts", slide).alias("pane")).agg(
        F.min(F.struct(order.alias("at"), "price")).alias("first"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max(F.struct(order.alias("at"), "price")).alias("last"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_ticks"))
    at = F.window_time("pane")
    return panes.select("*", at.alias("at")).groupBy("code", F.window("at", width, slide).alias("w")).agg(
        F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("last"),
        F.sum("volume").alias("volume"), F.sum("n_ticks").alias("n_ticks"),
    ).select("code", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("first.price").alias("open"), "high", "low",
             F.col("last.price").alias("close"), "volume", "n_ticks")


# ---- validation ------------------------------------------------------------------------------------------------------


def bad_bar():
    low, high, o, c = (F.col(x) for x in ("low", "high", "open", "close"))
    broken = (low > high) | (o < low) | (o > high) | (c < low) | (c > high) | (F.col("volume") < 0)
    return F.coalesce(broken, F.lit(True))


BATCH = "_batch"  # the batch that a good bar came with


def start_validation(stream: DataFrame, good: str, rejected: str, checkpoint: str, interval: str | None = None, writer: str = "validation"):
    """Route inconsistent bars to a reject folder and the first copy of each valid bar to the good table, however late it comes.

    The memory of earlier copies is the good table itself, by month: a batch meets only the months it touches, and of equal
    (code, date) the one of the earliest batch stays. Nothing is kept in memory, so no bar is too late. Reject folders are per batch, so a
    replay replaces them. Read the good table by `good_bars`.
    """
    def route(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("_bad", bad_bar())
        marked.where("_bad").drop("_bad").write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        valid = marked.where(~F.col("_bad")).drop("_bad").withColumn(BATCH, F.lit(batch_id).cast("long"))
        snapshots.merge(valid, good, writer, batch_id, ["code", "date"], BATCH, "first")

    return [_trigger(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(route), interval).start()]


def good_bars(spark: SparkSession, good: str) -> DataFrame | None:
    rows = snapshots.rows_of(spark, good, snapshots.latest(spark, good))
    return None if rows is None else rows.drop(BATCH)


def closed_windows(done: DataFrame, ticks: DataFrame, width: str = "1 day", slide: str | None = None, watermark: str = "1 day") -> DataFrame:
    """What a finished stream wrote, and the windows its watermark had not passed, from the ticks that can still be in them."""
    last = ticks.agg((F.max("ts") - F.expr(f"INTERVAL {watermark}")).alias("_mark"))  # one row
    marked = ticks.crossJoin(F.broadcast(last))
    late = ohlcv(marked.where(F.col("ts") > F.col("_mark") - F.expr(f"INTERVAL {width}")), width, slide)
    still_open = late.crossJoin(F.broadcast(last)).where(F.col("end") > F.col("_mark")).drop("_mark")
    return done.unionByName(still_open.join(done.select("code", "start"), ["code", "start"], "left_anti").select(*done.columns))
