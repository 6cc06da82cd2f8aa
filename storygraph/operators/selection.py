"""Row filters: validation, lookback windows, pending articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storygraph.params import Params


def reject_reason() -> Column:
    """NULL for a storable article."""
    return F.when(F.coalesce(F.size("article_content"), F.lit(0)) <= 0, "empty_content").when(
        F.col("article_title").isNull(), "missing_title"
    )


def valid_articles(articles: DataFrame) -> DataFrame:
    return articles.filter(reject_reason().isNull())


def rejected_articles(articles: DataFrame) -> DataFrame:
    return articles.withColumn("reason", reject_reason()).filter("reason is not null")


def new_articles(articles: DataFrame, as_of: int, params: Params = Params()) -> DataFrame:
    """Unclustered articles of the lookback, its lower end included; undated ones never match."""
    return articles.filter(
        F.col("cluster_id").isNull() & (F.col("article_published_date") >= as_of - params.article_lookback_s)
    )


def recent_clusters(clusters: DataFrame, as_of: int, params: Params = Params()) -> DataFrame:
    return clusters.filter(F.col("last_updated") >= as_of - params.cluster_lookback_s)
