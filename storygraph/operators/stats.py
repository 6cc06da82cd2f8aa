"""Article counters per source and per source and category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def article_stats(articles: DataFrame, category: str = "article_category") -> DataFrame:
    """(source, metric, value): ``total_articles`` and ``category_<c>`` from one pass."""
    level = F.grouping(category)
    metric = F.when(F.col("_total") == 1, F.lit("total_articles")).otherwise(F.concat(F.lit("category_"), F.col(category)))
    return (
        articles.rollup("source", category)
        .agg(F.count(F.lit(1)).alias("value"), level.alias("_total"), F.grouping("source").alias("_all"))
        .filter("_all = 0")
        .select("source", metric.alias("metric"), "value")
    )


def stats_increment(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored counters plus a delta; a counter only one side knows is kept."""
    return (
        stored.select("source", "metric", "value")
        .unionByName(delta.select("source", "metric", "value"))
        .groupBy("source", "metric")
        .agg(F.sum("value").alias("value"))
    )
