"""Shared-folder tables, connected components and small column helpers of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines see: spark.checkpoint.dir. Only a single-machine session without it gets a private one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return context.getCheckpointDir().rstrip("/")


BATCH_KEY, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def small_batches(spark: SparkSession) -> None:
    """Let the session send 1000 whole texts to Python at once instead of 10 000, unless its user chose another number."""
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def stage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and continue from the files, which outlive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Remove the tables of `stage` that these frames read. Only for frames whose results are themselves staged by now."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("llm-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_crc(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id in edges (u, v); label is the smallest id reachable. Null ends and loops are ignored.

    Each round hooks every id to its smallest neighbour (a partial aggregate, so a hub costs one row per task), follows these
    hooks to their ends by jumping, and puts the ends in place of the ids in the edges; loops and repeated edges go, so edges
    and ids shrink from round to round. The rounds' hooks are followed back at the end.
    """
    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    pairs, rounds = stage(ordered(edges)), []
    while not rounds or pairs.limit(1).count():
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = stage(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("label")))
        while True:
            ends = hooks.select(F.col("id").alias("label"), F.col("label").alias("end"))
            after = stage(hooks.join(ends, "label").select("id", F.col("end").alias("label"), (F.col("end") < F.col("label")).alias("moved")))
            release(hooks)
            hooks = after.select("id", "label")
            if not after.where("moved").limit(1).count():
                break
        left = pairs.join(hooks.select(F.col("id").alias("u"), F.col("label").alias("x")), "u").join(
            hooks.select(F.col("id").alias("v"), F.col("label").alias("y")), "v")
        shrunk = stage(ordered(left.select(F.col("x").alias("u"), F.col("y").alias("v"))))
        release(pairs)
        pairs = shrunk
        rounds.append(hooks)
    labels = rounds.pop()
    while rounds:
        earlier = rounds.pop()
        # ends of a round that have no edge left in the next one keep their label
        onward = labels.select(F.col("id").alias("label"), F.col("label").alias("end"))
        joined = stage(earlier.join(onward, "label", "left").select("id", F.coalesce("end", "label").alias("label")))
        release(labels, earlier)
        labels = joined
    return labels
