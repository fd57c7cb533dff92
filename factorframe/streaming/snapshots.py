"""A table of rows by month that several writers merge into, read through one small list of folders.

A snapshot is a JSON file: month -> folders, with the merge rule and the last batch of each writer. Writers add folders first
and then publish the next snapshot under the next number, which only one of them can take; who comes second reads the new snapshot,
keeps its folders if nobody touched the same months, and merges again if somebody did. So nothing is overwritten, a crash before the
snapshot leaves folders that nobody reads, and a replayed batch finds itself done.

A batch that is small against a month is added beside it; once the additions reach 1 / RATIO of the month, the month is merged into one
folder. Readers merge only months with additions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorframe.operators.filters import dedupe

RATIO = 8
EMPTY: dict = {"version": 0, "months": {}, "done": {}}


class Taken(Exception):
    """Another writer published this version."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _fs(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, target: str) -> list[int]:
    folder = f"{target}/_snapshots"
    fs = _fs(spark, folder)
    if not fs.exists(_path(spark, folder)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(_path(spark, folder))]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))


def latest(spark: SparkSession, target: str) -> dict:
    """The newest snapshot; an empty one before the first."""
    versions = _versions(spark, target)
    if not versions:
        return json.loads(json.dumps(EMPTY))
    name = f"{target}/_snapshots/{versions[-1]:012d}.json"
    stream = _fs(spark, name).open(_path(spark, name))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, target: str, snapshot: dict) -> None:
    """Write the snapshot under its version in one step; raises Taken if that version exists."""
    folder = f"{target}/_snapshots"
    draft, final = f"{folder}/_{uuid.uuid4().hex}", f"{folder}/{snapshot['version']:012d}.json"
    fs = _fs(spark, folder)
    stream = fs.create(_path(spark, draft))
    stream.write(bytearray(json.dumps(snapshot).encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no overwriting
    try:
        context.rename(_path(spark, draft), _path(spark, final), options)
    except Exception as error:
        fs.delete(_path(spark, draft), False)
        if "FileAlreadyExists" in str(error):
            raise Taken(final) from error
        raise


def _rows(spark: SparkSession, target: str, snapshot: dict, folders: Sequence[str]) -> DataFrame:
    schema = T.StructType.fromJson(snapshot["schema"])
    return spark.read.schema(schema).parquet(*[f"{target}/{f}" for f in folders])


def rows_of(spark: SparkSession, target: str, snapshot: dict, months: Sequence[str] | None = None) -> DataFrame | None:
    """The merged rows of a snapshot (of some months), None where there are none. Two branches at most, however many batches came."""
    chosen = [parts for month, parts in snapshot["months"].items() if months is None or month in months]
    single = [parts[0][0] for parts in chosen if len(parts) == 1]
    several = [folder for parts in chosen if len(parts) > 1 for folder, _ in parts]
    frames = [_rows(spark, target, snapshot, single)] if single else []
    if several:
        rule = snapshot["rule"]
        frames.append(dedupe(_rows(spark, target, snapshot, several), rule["keys"], rule["order"], rule["keep"]))
    return None if not frames else frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def _written(rows: DataFrame, target: str) -> dict[str, list]:
    """Write rows by month into a new folder: month -> [folder, rows]."""
    spark, name = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    # the rebalance hint sizes files by their bytes, splitting a large month and joining small ones
    rows.hint("rebalance", "month").write.partitionBy("month").parquet(f"{target}/{name}")
    counts = spark.read.parquet(f"{target}/{name}").groupBy("month").count().collect() if _has_months(spark, f"{target}/{name}") else []
    return {str(r["month"]): [f"{name}/month={r['month']}", r["count"]] for r in counts}  # a row per month


def _has_months(spark: SparkSession, folder: str) -> bool:
    return any(s.getPath().getName().startswith("month=") for s in _fs(spark, folder).listStatus(_path(spark, folder)))


def merge(
    fresh: DataFrame, target: str, writer: str, batch_id: int, keys: Sequence[str] = ("code", "date"), order: str = "ingest", keep: str = "last",
    date: str = "date",
) -> dict:
    """Merge rows into the months they touch and publish; of equal keys the last (first) by order stays. Returns the snapshot."""
    spark = fresh.sparkSession
    snapshot = latest(spark, target)
    rule = {"keys": list(keys), "order": order, "keep": keep}
    marked = dedupe(fresh.withColumn("month", F.date_format(date, "yyyyMM").cast("int")), list(keys), order, keep)
    sizes = None
    while True:
        if snapshot["done"].get(writer, -1) >= batch_id:
            return snapshot
        if not snapshot["months"]:  # a first load touches nothing: its months are known once they are written
            added = _written(marked, target)
            sizes = {m: n for m, (_, n) in added.items()}
        elif sizes is None:
            sizes = {str(r["month"]): r["count"] for r in marked.groupBy("month").count().collect()}  # a row per month
        before = {m: snapshot["months"].get(m, []) for m in sizes}
        # merged into one folder, or put beside the month
        whole = [m for m, n in sizes.items() if not before[m] or RATIO * (n + sum(k for _, k in before[m][1:])) >= before[m][0][1]]
        old = rows_of(spark, target, snapshot, [m for m in whole if before[m]]) if any(before[m] for m in whole) else None
        rows = marked
        if old is not None:
            rows = dedupe(marked.unionByName(old.withColumn("month", F.date_format(date, "yyyyMM").cast("int"))), list(keys), order, keep)
        if snapshot["months"]:
            added = _written(rows, target)
        while True:
            months = dict(snapshot["months"])
            for m, part in added.items():
                months[m] = [part] if m in whole else [*before[m], part]
            following = {"version": snapshot["version"] + 1, "months": months, "done": {**snapshot["done"], writer: batch_id}, "rule": rule,
                         "schema": json.loads(fresh.schema.json())}
            try:
                publish(spark, target, following)
                return following
            except Taken:
                snapshot = latest(spark, target)
                if snapshot["done"].get(writer, -1) >= batch_id or any(snapshot["months"].get(m, []) != before[m] for m in sizes):
                    break  # somebody touched the same months: merge again


def compact(spark: SparkSession, target: str, date: str = "date") -> dict:
    """Merge every month with additions into one folder."""
    while True:
        snapshot = latest(spark, target)
        months = [m for m, parts in snapshot["months"].items() if len(parts) > 1]
        if not months:
            return snapshot
        added = _written(rows_of(spark, target, snapshot, months).withColumn("month", F.date_format(date, "yyyyMM").cast("int")), target)
        following = {**snapshot, "version": snapshot["version"] + 1, "months": {**snapshot["months"], **{m: [p] for m, p in added.items()}}}
        try:
            publish(spark, target, following)
            return following
        except Taken:
            continue


def expire(spark: SparkSession, target: str, keep: int = 5) -> int:
    """Remove all but the newest snapshots and the folders that none of those names; not while a merge runs. Returns folders removed."""
    versions = _versions(spark, target)
    fs = _fs(spark, target)
    for v in versions[:-keep]:
        fs.delete(_path(spark, f"{target}/_snapshots/{v:012d}.json"), False)
    held = set()
    for v in versions[-keep:]:
        name = f"{target}/_snapshots/{v:012d}.json"
        stream = fs.open(_path(spark, name))
        held |= {f for parts in json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["months"].values() for f, _ in parts}
        stream.close()
    removed = 0
    for folder in fs.listStatus(_path(spark, f"{target}/data")):
        name = f"data/{folder.getPath().getName()}"
        for month in fs.listStatus(folder.getPath()):
            part = f"{name}/{month.getPath().getName()}"
            if month.isDirectory() and part not in held:
                fs.delete(month.getPath(), True)
                removed += 1
    return removed
