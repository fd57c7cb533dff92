"""Streams against their batch results, with replays and late rows."""

import pytest

from conftest import days, frame

from factorframe.operators import filters
from factorframe.operators.quality import adjust_events
from factorframe.streaming import bars as Z
from factorframe.streaming import snapshots

SCHEMA = "code string, date date, close double, ingest int"


def run_upsert(spark, folder, name="ckpt"):
    stream = Z.stream_files(spark, f"{folder}/in", frame(spark, SCHEMA, []).schema)
    Z.start_upsert(stream, f"{folder}/bars", f"{folder}/{name}").awaitTermination()
    return {(r["code"], str(r["date"])): r["close"] for r in Z.current_bars(spark, f"{folder}/bars").collect()}


def test_upsert_merges_replays_and_keeps_other_years(spark, tmp_path):
    folder = str(tmp_path)
    frame(spark, SCHEMA, [("a", "2019-12-31", 1.0, 1), ("a", "2020-01-01", 2.0, 1), ("b", "2020-01-01", 3.0, 1)]).write.parquet(f"{folder}/in")
    assert run_upsert(spark, folder) == {("a", "2019-12-31"): 1.0, ("a", "2020-01-01"): 2.0, ("b", "2020-01-01"): 3.0}
    update = frame(spark, SCHEMA, [("a", "2020-01-01", 9.0, 2), ("a", "2020-01-02", 4.0, 2)])
    update.write.mode("append").parquet(f"{folder}/in")
    want = {("a", "2019-12-31"): 1.0, ("a", "2020-01-01"): 9.0, ("a", "2020-01-02"): 4.0, ("b", "2020-01-01"): 3.0}
    assert run_upsert(spark, folder) == want
    Z.upsert_batch(update, 1, f"{folder}/bars")  # the same batch again changes nothing
    assert {(r["code"], str(r["date"])): r["close"] for r in Z.current_bars(spark, f"{folder}/bars").collect()} == want


def run_events(spark, folder, loads, **options):
    schema = "code string, date date, close double"
    for load in loads:
        frame(spark, schema, load).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = Z.stream_files(spark, f"{folder}/in", frame(spark, schema, []).schema)
        writer = Z.adjust_events(stream, **options).writeStream.format("parquet").option("path", f"{folder}/out")
        writer.option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start().awaitTermination()
    settled = Z.settled_events(spark.read.parquet(f"{folder}/out"))
    return {(r["code"], str(r["date"]), r["prev_close"], r["close"]) for r in settled.collect()}


def batch_events(spark, rows):
    return {(r["code"], str(r["date"]), r["prev_close"], r["close"]) for r in adjust_events(frame(spark, "code string, date date, close double", rows)).collect()}


def test_late_bars_correct_events(spark, tmp_path):
    """Out of order, with a jump that a late bar takes away and one that it brings."""
    d = days(8)
    loads = [[("a", d[0], 10.0), ("a", d[2], 20.0), ("a", d[5], 20.5)], [("a", d[1], 19.5), ("a", d[4], 50.0), ("b", d[6], 1.0)],
             [("b", d[4], 3.0), ("a", d[3], 48.0), ("a", d[6], 20.4)]]
    want = batch_events(spark, [r for load in loads for r in load])
    assert run_events(spark, str(tmp_path), loads) == want
    assert ("a", d[1], 10.0, 19.5) in want and all(e[1] != d[2] for e in want) and ("a", d[3], 20.0, 48.0) in want and ("b", d[6], 3.0, 1.0) in want


def test_events_state_is_bounded(spark, tmp_path):
    d = days(60)
    loads = [[("a", d[0], 10.0), ("a", d[1], 10.1), ("a", d[40], 10.2)], [("a", d[2], 99.0), ("a", d[35], 30.0), ("a", d[41], 10.3)]]
    # 5 days before the newest bar: the bar of day 2 is too late, that of day 35 is not
    timely = [r for load in loads for r in load if r[2] != 99.0]
    assert run_events(spark, str(tmp_path), loads, lateness_days=5) == batch_events(spark, timely)


def test_unreadable_batch_fails_loudly(spark, tmp_path):
    import glob
    import pytest

    folder = str(tmp_path)
    frame(spark, SCHEMA, [("a", "2020-01-01", 2.0, 1), ("b", "2020-02-01", 3.0, 1)]).write.parquet(f"{folder}/in")
    run_upsert(spark, folder)
    for path in glob.glob(f"{folder}/bars/data/*/month=*/*.parquet"):
        open(path, "wb").write(b"broken")
    for path in glob.glob(f"{folder}/bars/data/*/month=*/.*.crc"):
        open(path, "wb").write(b"")
    with pytest.raises(Exception):
        Z.upsert_batch(frame(spark, SCHEMA, [("a", "2020-01-02", 4.0, 2)]), 1, f"{folder}/bars")
    assert snapshots.latest(spark, f"{folder}/bars")["done"] == {"upsert": 0}


def bars_of(spark, target):
    return {(r["code"], str(r["date"])): r["close"] for r in Z.current_bars(spark, target).collect()}


def test_empty_batches_and_compaction(spark, tmp_path):
    target = f"{tmp_path}/bars"
    Z.upsert_batch(frame(spark, SCHEMA, []), 0, target)
    assert Z.current_bars(spark, target) is None
    Z.upsert_batch(frame(spark, SCHEMA, [("a", "2020-01-01", 2.0, 1), ("b", "2020-03-01", 5.0, 1)]), 1, target)
    Z.upsert_batch(frame(spark, SCHEMA, [("a", "2020-01-01", 7.0, 2)]), 2, target)
    Z.compact_bars(spark, target)
    Z.upsert_batch(frame(spark, SCHEMA, [("a", "2020-01-02", 8.0, 3)]), 3, target)
    assert bars_of(spark, target) == {("a", "2020-01-01"): 7.0, ("a", "2020-01-02"): 8.0, ("b", "2020-03-01"): 5.0}
    calendar, listed = Z.refresh_dimensions(spark, target)
    assert calendar.count() == 3 and {r["code"]: str(r["end_date"]) for r in listed.collect()} == {"a": "2020-01-02", "b": "2020-03-01"}


def test_first_load_reads_its_batch_once(spark, tmp_path):
    """No months are there to be merged, so the batch is not aggregated for their sizes before it is written; and a row moves once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for part in frames:
            seen.add(len(part))
            yield part

    target, load = f"{tmp_path}/bars", frame(spark, SCHEMA, [("a", d, float(i), i) for i, d in enumerate(days(90))] + [("a", days(1)[0], 7.0, 99)])
    Z.upsert_batch(load.mapInPandas(counted, load.schema), 0, target)
    assert seen.value == 91 and len(bars_of(spark, target)) == 90 and bars_of(spark, target)["a", days(1)[0]] == 7.0
    assert {m: parts[0][1] for m, parts in snapshots.latest(spark, target)["months"].items()} == {"202001": 31, "202002": 29, "202003": 30}
    plan = filters.dedupe(load, ["code", "date"], "ingest")._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and plan.count("struct(") == 1


def test_small_batches_stand_beside_a_month_until_they_are_an_eighth(spark, tmp_path):
    target = f"{tmp_path}/bars"
    codes = [f"c{i:02d}" for i in range(40)]
    Z.upsert_batch(frame(spark, SCHEMA, [(c, "2020-01-05", 1.0, 0) for c in codes]), 0, target)
    want = {(c, "2020-01-05"): 1.0 for c in codes}
    folders = []
    for i in range(1, 9):
        load = [(codes[i], "2020-01-05", 10.0 + i, i), (f"new{i}", "2020-01-06", 1.0 * i, i)]
        Z.upsert_batch(frame(spark, SCHEMA, load), i, target)
        want |= {(c, d): x for c, d, x, _ in load}
        folders.append(len(snapshots.latest(spark, target)["months"]["202001"]))
        assert bars_of(spark, target) == want
    assert max(folders) == 3 and folders.count(1) >= 2  # added, added, merged
    before = snapshots.latest(spark, target)["version"]
    Z.compact_bars(spark, target)
    assert len(snapshots.latest(spark, target)["months"]["202001"]) == 1 and snapshots.latest(spark, target)["version"] in (before, before + 1)
    assert snapshots.expire(spark, target, keep=1) > 0 and bars_of(spark, target) == want


def test_two_writers_lose_no_bars(spark, tmp_path, monkeypatch):
    """Another stream publishes between this one's data and its snapshot: the same month is merged again, another month is only kept."""
    target = f"{tmp_path}/bars"
    Z.upsert_batch(frame(spark, SCHEMA, [("a", "2020-01-01", 1.0, 1)]), 0, target)
    publish, rivals = snapshots.publish, []

    def late(session, where, snapshot):
        if rivals:
            load, number = rivals.pop()
            Z.upsert_batch(frame(spark, SCHEMA, load), number, target, writer="rival")
        publish(session, where, snapshot)

    monkeypatch.setattr(snapshots, "publish", late)
    rivals.append(([("b", "2020-01-02", 2.0, 1)], 0))
    Z.upsert_batch(frame(spark, SCHEMA, [("c", "2020-01-03", 3.0, 1)]), 1, target)
    rivals.append(([("d", "2020-05-02", 4.0, 1)], 1))
    Z.upsert_batch(frame(spark, SCHEMA, [("e", "2020-01-04", 5.0, 1)]), 2, target)
    assert {k[0]: v for k, v in bars_of(spark, target).items()} == {"a": 1.0, "b": 2.0, "c": 3.0, "d": 4.0, "e": 5.0}
    assert snapshots.latest(spark, target)["done"] == {"upsert": 2, "rival": 1}


def test_crash_between_data_and_snapshot(spark, tmp_path, monkeypatch):
    target = f"{tmp_path}/bars"
    Z.upsert_batch(frame(spark, SCHEMA, [("a", "2020-01-01", 1.0, 1)]), 0, target)
    publish = snapshots.publish

    def crash(*_):
        raise RuntimeError("lost driver")

    monkeypatch.setattr(snapshots, "publish", crash)
    load = frame(spark, SCHEMA, [("a", "2020-01-01", 2.0, 2)])
    with pytest.raises(RuntimeError):
        Z.upsert_batch(load, 1, target)
    assert bars_of(spark, target) == {("a", "2020-01-01"): 1.0}
    monkeypatch.setattr(snapshots, "publish", publish)
    Z.upsert_batch(load, 1, target)
    assert bars_of(spark, target) == {("a", "2020-01-01"): 2.0}
    assert snapshots.expire(spark, target, keep=1) == 2  # the lost folder and the old month


def test_validation_keeps_late_bars(spark, tmp_path):
    schema = "code string, date date, open double, high double, low double, close double, volume double"
    folder = str(tmp_path)
    loads = [[("a", "2020-06-01", 1.0, 2.0, 1.0, 1.5, 1.0), ("c", "2020-06-01", 1.0, 2.0, 1.0, 1.5, 1.0), ("a", "2020-06-01", 1.0, 2.0, 1.0, 1.5, 1.0)],
             [("a", "2010-01-01", 1.0, 2.0, 1.0, 1.5, 1.0), ("a", "2020-06-01", 1.0, 2.0, 1.0, 1.7, 1.0), ("b", "2020-06-01", 9.0, 2.0, 1.0, 1.5, 1.0)]]
    for load in loads:
        frame(spark, schema, load).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = Z.stream_files(spark, f"{folder}/in", frame(spark, schema, []).schema)
        for q in Z.start_validation(stream, f"{folder}/good", f"{folder}/bad", f"{folder}/ckpt"):
            q.awaitTermination()
    good = Z.good_bars(spark, f"{folder}/good")
    assert good.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted((r.code, str(r.date), r.close) for r in good.collect()) == [("a", "2010-01-01", 1.5), ("a", "2020-06-01", 1.5), ("c", "2020-06-01", 1.5)]
    assert [r.code for r in spark.read.parquet(f"{folder}/bad/batch=*").collect()] == ["b"]


def test_sliding_stream_equals_static_windows(spark, tmp_path):
    import datetime
    import random

    r = random.Random(3)
    start = datetime.datetime(2020, 1, 1)
    rows = sorted(((r.choice("ab"), start + datetime.timedelta(minutes=r.randrange(6000)), i, float(r.randrange(100)), 1.0) for i in range(400)), key=lambda x: x[1])
    schema = "code string, ts timestamp, seq int, price double, volume double"
    for i in range(4):
        spark.createDataFrame(rows[i * 100:(i + 1) * 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = Z.stream_files(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, files_per_batch=1)
    bars = Z.sliding_ohlcv(stream, "12 hours", "4 hours", "1 hour")
    out = bars.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt")
    out.trigger(availableNow=True).start().awaitTermination()
    every = spark.createDataFrame(rows, schema)
    done = spark.read.schema(bars.schema).parquet(f"{tmp_path}/out")
    want = {tuple(x) for x in Z.ohlcv(every, "12 hours", "4 hours").collect()}
    written = {tuple(x) for x in done.collect()}
    assert written and written <= want
    assert {tuple(x) for x in Z.closed_windows(done, every, "12 hours", "4 hours", "1 hour").collect()} == want
