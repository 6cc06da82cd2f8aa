"""Ingest run: listing -> unseen -> quota -> article -> validate -> enrich -> store."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storygraph.functions.dates import utc_day
from storygraph.functions.urls import source_name
from storygraph.operators.embed import embed_articles
from storygraph.operators.extract import extract_listing, requested_records, requests
from storygraph.operators.ledger import first_requests, ledger_of_day, ledger_rows, listing_quota, unseen_urls
from storygraph.operators.models import Models
from storygraph.operators.profiles import PROFILES, SiteProfile
from storygraph.operators.selection import rejected_articles, valid_articles
from storygraph.operators.stats import article_stats
from storygraph.operators.summarize import summarize_articles
from storygraph.params import DAY_S, Params
from storygraph.schemas import ARTICLES, REQUESTS
from storygraph.session import materialize, scratch
from storygraph.sources.tables import Store


REQUEST_KEY = ["source", "category", "article_url"]


def article_id(as_of: int):
    """Key of an article stored at ``as_of``; the same again when a batch is replayed."""
    day = utc_day(F.lit(as_of).cast("bigint"))
    return F.sha2(F.concat_ws("#", "source", F.coalesce("article_category", F.lit("")), "article_url", day.cast("string")), 256)


def enrich(articles: DataFrame, models: Models = Models(), params: Params = Params()) -> DataFrame:
    """Embedding for every article, summary for the long ones."""
    embedded = embed_articles(articles, models.embed, params, models.tokenizer)
    return summarize_articles(embedded, models.summarize, params, models.tokenizer)


def stored_form(articles: DataFrame, as_of: int) -> DataFrame:
    """The columns that are stored, with the article key and no cluster yet."""
    keyed = articles.withColumn("article_id", article_id(as_of)).withColumn("cluster_id", F.lit(None).cast("string"))
    return keyed.select(ARTICLES.fieldNames())


def to_follow(listing: DataFrame, ledger: DataFrame, as_of: int, params: Params = Params()) -> DataFrame:
    """Listing entries to follow: not seen that day, within the quota, each URL once."""
    fresh = unseen_urls(listing, ledger_of_day(ledger, as_of, params))
    return first_requests(listing_quota(fresh, params))


@dataclass
class Ingested:
    """``waiting`` are the requests whose page has not come yet."""

    articles: DataFrame
    rejected: DataFrame
    ledger: DataFrame
    stats: DataFrame
    waiting: DataFrame


def ingest_run(
    pages: DataFrame,
    ledger: DataFrame,
    as_of: int,
    params: Params = Params(),
    models: Models = Models(),
    profiles: Sequence[SiteProfile] = PROFILES,
    waiting: DataFrame | None = None,
) -> Ingested:
    """What one crawl adds: articles, rejects, ledger rows, counter deltas, requests left open."""
    return ingest_listing(extract_listing(pages, profiles), pages, ledger, as_of, params, models, profiles, waiting)


def ingest_listing(
    listing: DataFrame,
    pages: DataFrame,
    ledger: DataFrame,
    as_of: int,
    params: Params = Params(),
    models: Models = Models(),
    profiles: Sequence[SiteProfile] = PROFILES,
    waiting: DataFrame | None = None,
) -> Ingested:
    """The same from listing entries that are already there.

    ``waiting`` are requests of earlier runs: they meet the pages of this one, without a place
    in the quota, and an entry that waits already takes no place either. Names of sources are
    brought into their plain form (``source_name``) first, in the listing and the profiles.
    """
    profiles = plain_profiles(profiles)
    listing = listing.withColumn("source", source_name(F.col("source")))
    if waiting is not None:
        listing = listing.join(waiting.select(REQUEST_KEY).distinct(), REQUEST_KEY, "left_anti").select(listing.columns)
    followed = requests(to_follow(listing, ledger, as_of, params)).withColumn("asked_at", F.lit(as_of).cast("bigint"))
    asked = followed.select(REQUESTS.fieldNames())
    if waiting is not None:
        asked = asked.unionByName(waiting.select(REQUESTS.fieldNames()))
    asked, seen = materialize(asked)
    records = requested_records(asked, pages, profiles, seen["rows"])
    stored = stored_form(enrich(valid_articles(records), models, params), as_of)
    come = pages.filter("html is not null").select(F.col("url").alias("request_url")).distinct()
    still = asked.filter(F.col("asked_at") >= as_of - params.request_days * DAY_S).join(come, "request_url", "left_anti")
    return with_side_tables(stored, rejected_articles(records), as_of, still.select(REQUESTS.fieldNames()))


def plain_profiles(profiles: Sequence[SiteProfile]) -> list[SiteProfile]:
    """The profiles under the plain form of their names, which must differ."""
    plain = [replace(p, source=p.source.lower().split("_")[0]) for p in profiles]
    if len({p.source for p in plain}) < len(plain):
        raise ValueError("two profiles share the plain form of their name")
    return plain


def with_side_tables(stored: DataFrame, rejected: DataFrame, as_of: int, waiting: DataFrame) -> Ingested:
    seen = stored.select(
        "source", F.col("article_category").alias("category"), F.col("article_url").alias("url"), F.lit(as_of).cast("bigint").alias("ts_s")
    )
    return Ingested(stored, rejected, ledger_rows(seen), article_stats(stored), waiting)


def ingest_batch(
    store: Store,
    pages: DataFrame,
    batch: int,
    now: int,
    params: Params = Params(),
    models: Models = Models(),
    profiles: Sequence[SiteProfile] = PROFILES,
) -> None:
    """Run one ingest batch against the stored tables. Running it again changes nothing."""
    as_of, _ = store.open_run("ingest", batch, now)
    with scratch(store.spark):
        waiting = store.requests(before=batch, since=as_of - params.request_days * DAY_S)
        run = ingest_run(pages, store.ledger(before=batch, since=as_of - params.dedup_days * DAY_S), as_of, params, models, profiles, waiting)
        # Written once apart: pages are not parsed again for ledger and counters, and no stored folder is listed.
        articles, _ = materialize(run.articles)
        store.add_articles(articles, batch)
        store.add_requests(run.waiting, batch)
        side = with_side_tables(articles, run.rejected, as_of, run.waiting)
        store.add_ledger(side.ledger, batch)
        store.add_stats(side.stats, batch)
    store.close_run("ingest", batch)
