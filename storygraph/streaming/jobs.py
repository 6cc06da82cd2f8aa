"""Streams: ingest and cluster runs per micro-batch, the URL ledger, running counters."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storygraph.operators.ledger import ledger_additions, ledger_rows
from storygraph.operators.models import Models
from storygraph.operators.profiles import PROFILES, SiteProfile
from storygraph.params import Params
from storygraph.plans.cluster import cluster_batch
from storygraph.plans.ingest import ingest_batch
from storygraph.session import materialize, scratch
from storygraph.sources.tables import Store

INTERVAL = "10 seconds"


def _start(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)
    return writer.start()


def ingest_stream(
    pages: DataFrame,
    store: Store,
    checkpoint: str,
    params: Params = Params(),
    models: Models = Models(),
    profiles: Sequence[SiteProfile] = PROFILES,
    clock: Callable[[], float] = time.time,
    once: bool = False,
) -> StreamingQuery:
    """Ingest each micro-batch of pages: listing pages and the article pages they lead to."""

    def body(batch_pages: DataFrame, batch: int) -> None:
        ingest_batch(store, batch_pages, batch, int(clock()), params, models, profiles)

    return _start(pages, body, checkpoint, once)


def cluster_stream(
    ticks: DataFrame,
    store: Store,
    checkpoint: str,
    params: Params = Params(),
    models: Models = Models(),
    clock: Callable[[], float] = time.time,
    once: bool = False,
) -> StreamingQuery:
    """Run the cluster job every 10 seconds. ``ticks`` only sets the pace (a rate or file stream).

    Micro-batches of a query follow one another, so two runs never overlap. What
    stays noise is met again by later runs until it is older than the lookback.
    """

    def body(_: DataFrame, batch: int) -> None:
        cluster_batch(store, batch, int(clock()), params, models)

    return _start(ticks, body, checkpoint, once)


def ledger_stream(feed: DataFrame, store: Store, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Add each (source, category, url) and UTC day of a stream with ``ts_s`` (epoch seconds) to the ledger once.

    What was seen is looked up in the stored ledger, by the days of the batch, not in a state
    with a watermark: a row may come any number of days late, and nothing is held in memory.
    """

    def body(rows: DataFrame, batch: int) -> None:
        store.open_run("ledger", batch, 0)
        with scratch(store.spark):
            new, seen = materialize(ledger_rows(rows), first=F.min("day"))
            stored = store.ledger(before=batch, since=seen["first"]).join(new.select("day").distinct(), "day", "left_semi")
            store.add_ledger(ledger_additions(new, stored), batch)
        store.close_run("ledger", batch)

    return _start(feed, body, checkpoint, once)


def running_stats(feed: DataFrame) -> DataFrame:
    """Running counters (source, metric, value) of articles: in all and per category; for the update output mode."""
    metrics = F.array(F.lit("total_articles"), F.concat(F.lit("category_"), "category"))
    return feed.select("source", F.explode(metrics).alias("metric")).groupBy("source", "metric").agg(F.count(F.lit(1)).alias("value"))
