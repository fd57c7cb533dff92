"""Session defaults and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Only settings the operators rely on. Shuffle width, memory and executor counts belong to the cluster.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # one Window node can hold a few dozen aggregates; let generated code grow with it
    "spark.sql.codegen.maxFields": "400",
    # the virtual machine never compiles methods above 8000 bytes; operators that need one are better run with their expressions split
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "factorframe", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def split_large_methods(spark: SparkSession) -> None:
    """The hugeMethodLimit of DEFAULT_CONF in a session built elsewhere, unless it has a lower one; results do not depend on it."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > int(DEFAULT_CONF[key]):
        spark.conf.set(key, DEFAULT_CONF[key])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder driver and executors share, from spark.checkpoint.dir; only a single-machine session may go without."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        single = context.master == "local" or context.master.startswith("local[")
        if not configured and not single:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="factorframe-ckpt-"))
    return configured or context.getCheckpointDir()


def fresh_folder(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint area."""
    return f"{ensure_checkpoint_dir(spark).removeprefix('file:').rstrip('/')}/factorframe-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a plan go as soon as it has run; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, by: str | None = None, slices: int = 1) -> DataFrame:
    """Write df to the shared folder once and go on from the files, for what several branches of a plan read.

    The files outlive lost executors and carry true sizes, by which Spark chooses broadcasts. With slices, rows go there in that many
    passes over the input, by the hash of the column by, so only one pass's shuffle files are on disk at a time. That saves shuffles
    where df is grouped by that column, since the slice is then chosen before them.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark)
    with shuffles_removed(spark):
        for i in range(slices):
            part = df if slices == 1 else df.where(F.pmod(F.xxhash64(by), F.lit(slices)) == i)
            part.write.mode("append").option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
