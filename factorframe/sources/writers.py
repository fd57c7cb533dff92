"""Sinks for panels, picks, reports and the experiment log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPERIMENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("recorder_id", T.StringType()),
        T.StructField("test_data_range", T.ArrayType(T.StringType())),
        T.StructField("config_summary", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def write_panel(panel: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Year partitions, clustered by code inside each so that one code's rows share few row groups.

    Rows go to (year, code range) rather than to the year alone: a year is never one task.
    """
    keyed = panel.withColumn("year", F.year("date"))
    clustered = keyed.repartitionByRange("year", "code").sortWithinPartitions("year", "code", "date")
    writer = clustered.write.mode(mode).partitionBy("year")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_picks(picks: DataFrame, path: str, model_id: str = "", config: Mapping[str, str] | None = None) -> None:
    """Picks as CSV under path/picks, and one JSON line of metadata per pick date under path/meta."""
    picks.write.mode("overwrite").option("header", True).csv(f"{path}/picks")
    snapshot = F.create_map(*[F.lit(x) for pair in (config or {"": ""}).items() for x in pair])
    meta = picks.groupBy("date").agg(F.count(F.lit(1)).alias("n_picks")).select(
        F.to_json(
            F.struct(
                F.date_format("date", "yyyyMMdd").alias("date"),
                F.current_timestamp().cast("string").alias("saved_at"),
                "n_picks",
                F.lit(model_id).alias("model_id"),
                (snapshot if config else F.create_map().cast("map<string,string>")).alias("config_snapshot"),
            )
        ).alias("value")
    )
    meta.write.mode("overwrite").text(f"{path}/meta")


def write_report(tables: Mapping[str, DataFrame], path: str, fmt: str = "csv") -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(f"{path}/{name}")


def read_report(spark: SparkSession, path: str, row: str, measures: Sequence[str], fmt: str = "csv") -> DataFrame:
    """One written table in long form: report (its name), row, measure, value."""
    reader = spark.read.format(fmt)
    df = (reader.option("header", True) if fmt == "csv" else reader).load(path)
    long = df.select(F.col(row).cast("string").alias("row"), *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(["row"], list(measures), "measure", "value")
    return long.select(F.lit(path.rstrip("/").rpartition("/")[2]).alias("report"), "row", "measure", "value")


def append_experiments(records: DataFrame, path: str) -> None:
    """Add experiment records to the JSON-lines log."""
    records.select(*[F.col(f.name).cast(f.dataType) for f in EXPERIMENT_SCHEMA.fields]).write.mode("append").json(path)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPERIMENT_SCHEMA).json(path)
