"""One query per operator with production parameters, and the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorframe.llm import (
    chat, collocations, decontaminate, language, lines, mixing, packing, quality, scoring, sharding, similarity, spelling, vectors,
)
from factorframe.llm.shared import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 3))


def op2_quality(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op3_lines(spark, sf_dir):
    return lines.repeats(table(spark, sf_dir, "documents"))


def op4_shard(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_chat(spark, sf_dir):
    return chat.chat_report(table(spark, sf_dir, "conversations"))


def op6_similar(spark, sf_dir):
    return similarity.components(table(spark, sf_dir, "documents"))


def op7_language(spark, sf_dir):
    return language.language_report(table(spark, sf_dir, "documents"))


def op8_score(spark, sf_dir):
    return scoring.score(table(spark, sf_dir, "documents"))


def op9_vectors(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op11_phrases(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_leaks(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix, op2_quality, op3_lines, op4_shard, op5_chat, op6_similar, op7_language, op8_score,
                                   op9_vectors, op10_pack, op11_phrases, op12_leaks, op13_spelling)}
SQL = {"op1_mix": mixing.SQL, "op2_quality": quality.SQL, "op5_chat": chat.SQL, "op11_phrases": collocations.SQL,
       "op12_leaks": decontaminate.SQL, "op13_spelling": spelling.SQL}
