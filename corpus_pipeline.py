"""A corpus pipeline: documents in, packed training sequences out. Each stage reads what the one before it wrote.

The five steps are operators of factorframe.llm; every stage but the last returns the columns of documents. Near copies are told by
shingles of five words at a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorframe.llm import language, lines, mixing, packing, similarity
from factorframe.llm.shared import small_batches, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that the model is at all sure of, go."""
    small_batches(spark)
    return language.keep_known(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id."""
    return similarity.drop_near_copies(docs, k=5, percent=80)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and sentences that an earlier document has are cut out of the texts."""
    return lines.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of the sources takes them."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("identify_language", identify_language),
    ("drop_near_copies", drop_near_copies),
    ("drop_repeats", drop_repeats),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
# Language models, minwise trees and tokenizers are not SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
