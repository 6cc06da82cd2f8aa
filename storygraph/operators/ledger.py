"""URL ledger: which URLs of a source and category were seen on a UTC day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storygraph.functions.dates import utc_day
from storygraph.params import DAY_S, Params

KEYS = ["source", "day", "category", "url"]


def ledger_rows(seen: DataFrame, ts_col: str = "ts_s") -> DataFrame:
    """Seen URLs (source, category, url, time in epoch seconds) as ledger rows, each once."""
    return seen.select("source", utc_day(F.col(ts_col)).alias("day"), "category", "url").distinct()


def ledger_of_day(ledger: DataFrame, as_of: int, params: Params = Params(), source: str | None = None) -> DataFrame:
    """The rows that block a URL at ``as_of``: those of its UTC day (or of the last ``dedup_days``)."""
    today = as_of - as_of % DAY_S
    rows = ledger.filter(F.col("day").between(today - (params.dedup_days - 1) * DAY_S, today))
    return rows if source is None else rows.filter(F.col("source") == source)


def ledger_additions(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to append so that the ledger is the union of both."""
    return new.select(KEYS).distinct().join(stored.select(KEYS), KEYS, "left_anti")


def ledger_documents(ledger: DataFrame, urls_per_chunk: int = 10000) -> DataFrame:
    """One sorted URL array per (source, day, category, chunk).

    A day of a busy category is cut into chunks by URL hash, so no array grows
    with the data.
    """
    counts = ledger.groupBy("source", "day", "category").agg(
        F.ceil(F.count_distinct("url") / urls_per_chunk).cast("bigint").alias("chunks")
    )
    spot = F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("bigint")
    return (
        ledger.select(KEYS)
        .distinct()
        .join(counts, ["source", "day", "category"])
        .withColumn("chunk", F.pmod(spot, F.col("chunks")))
        .groupBy("source", "day", "category", "chunk")
        .agg(F.sort_array(F.collect_list("url")).alias("urls"))
    )


def unseen_urls(listing: DataFrame, today: DataFrame) -> DataFrame:
    """Listing entries whose URL is not in the ledger under the same source and category."""
    blocked = today.select("source", "category", F.col("url").alias("article_url")).distinct()
    return listing.join(blocked, ["source", "category", "article_url"], "left_anti").select(listing.columns)


def listing_quota(unseen: DataFrame, params: Params = Params()) -> DataFrame:
    """The first ``max_articles`` unseen entries of each listing in document order.

    Each crawl of a listing (``fetched_at``, where there is one) has places of its own.
    """
    crawl = [c for c in ("listing_url", "fetched_at") if c in unseen.columns]
    order = Window.partitionBy(*crawl).orderBy("position", "article_url")
    return unseen.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= params.max_articles).drop("_rank")


def first_requests(entries: DataFrame) -> DataFrame:
    """Each URL of a source and category once. Follows the quota: a repeated entry uses up its place in the listing."""
    keys = ["source", "category", "article_url"]
    others = [c for c in entries.columns if c not in keys]
    order = F.struct("listing_url", "position")
    first = F.min_by(F.struct(*others), order).alias("_entry")
    return entries.groupBy(*keys).agg(first).select(*keys, "_entry.*").select(entries.columns)
