"""Raw pages as a batch table or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storygraph.schemas import PAGES


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def stream_pages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
