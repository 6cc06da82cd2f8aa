"""The corpus pipeline: its stages in order, each over all rows that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storygraph.llm.columns import word_count
from storygraph.llm.decontaminate import without_leaks
from storygraph.llm.mixing import mixed
from storygraph.llm.near_dedup import without_near_duplicates
from storygraph.llm.sharding import assign_shards
from storygraph.llm.toxicity import without_toxic
from storygraph.session import prepare, scratch_path

SHARDS = 24
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, fitted to ``labels``, do not reject."""
    prepare(spark)
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 4-word shingles, at most 4 differing bits."""
    prepare(spark)
    return without_near_duplicates(docs, shingle=4, distance=4)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``: 5-word shingles, a similarity of 0.8 or more."""
    prepare(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet their target weights."""
    prepare(spark)
    return mixed(docs, word_count(F.col("text")), [F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every row, by its id."""
    prepare(spark)
    return assign_shards(docs, [1.0] * SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

# Stages of learned models and fingerprints are beyond SQL: tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written to the shared folder and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            path = scratch_path(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
