"""Cluster run: assign new articles to recent clusters, group the rest, refresh what changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storygraph.operators.clusters import apply_models, build_clusters, extend_clusters, member_additions, member_articles, new_cluster_id
from storygraph.operators.dbscan import Density, dbscan, grow
from storygraph.functions.vectors import usable
from storygraph.operators.embed import fill_embeddings
from storygraph.operators.models import Models
from storygraph.operators.nearest import assign_to_clusters
from storygraph.operators.selection import new_articles, recent_clusters
from storygraph.params import Params
from storygraph.session import materialize, scratch
from storygraph.sources.tables import Store

# Articles that join a cluster are looked up by a broadcast of hashes of their ids up to so many.
BROADCAST_IDS = 500_000


@dataclass
class ClusterRun:
    """``decisions``: source, article_id, article_published_date, cluster_id, stage, similarity.

    ``stage`` is "assigned", "grouped" or "noise". ``changed`` holds the new rows of
    all touched clusters, built when asked for, ``members`` the additions. ``left_open`` is the
    noise with what the next run needs of it; ``searched`` rows were compared as new ones,
    ``known`` ones only with those.
    """

    decisions: DataFrame
    members: DataFrame
    metrics: DataFrame
    left_open: DataFrame
    searched: int
    known: int
    build: Callable[[], DataFrame]

    @cached_property
    def changed(self) -> DataFrame:
        return self.build()


def cluster_run(
    articles: DataFrame,
    clusters: DataFrame,
    as_of: int,
    params: Params = Params(),
    models: Models = Models(),
    members: DataFrame | None = None,
    all_articles: Callable[[int], DataFrame] | None = None,
    recent_members: DataFrame | None = None,
    open_noise: DataFrame | None = None,
    open_since: int = 0,
) -> ClusterRun:
    """One run over tables as they stand. All articles meet the cluster vectors of the run's start.

    ``article_id`` is unique over all sources. Vectors, decisions and the texts of
    the articles that join a cluster are each written out once. With models of
    your own a refreshed cluster is built from all of its members: ``members`` is
    their table and ``all_articles(since)`` gives the articles published from then on.
    Of rows repeated under one key the smallest counts. ``recent_members`` are the
    memberships that an article of the lookback may have already; these are not added again.
    ``open_noise`` is what a run at ``open_since`` left open. Articles in it have met each other
    and the clusters of that time: they meet new articles and clusters changed since, and
    no pair of them is searched again. The decisions are the same without it.
    """
    pending = new_articles(articles, as_of, params)
    state = recent_clusters(clusters, as_of, params)
    vectors = _one_per_article(
        fill_embeddings(pending.drop("cluster_id"), models.embed, params).select("article_id", "source", "article_published_date", "article_embeddings")
    )
    if open_noise is None:
        vectors, seen = materialize(vectors.withColumn("known", F.lit(False)), known=F.count_if(F.col("known")))
    else:
        seen_before = open_noise.select("article_id", F.lit(True).alias("known"))
        vectors = vectors.join(seen_before, "article_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
        vectors, seen = materialize(vectors, known=F.count_if(F.col("known")))

    def assigned_to(rows: DataFrame, to: DataFrame) -> DataFrame:
        return assign_to_clusters(rows, to, "article_id", "article_embeddings", params.assign_threshold, params)

    near = assigned_to(vectors.filter("not known"), state)
    if seen["known"]:
        near = near.unionByName(assigned_to(vectors.filter("known"), state.filter(F.col("last_updated") >= open_since)))
    near, _ = materialize(near)
    taken = near.filter("cluster_id is not null")
    rest, _ = materialize(vectors.select("article_id", "article_embeddings", "known").join(taken.select("article_id"), "article_id", "left_anti"))
    links = None
    if seen["known"] or params.min_samples > 2:
        density = grow(_stored_density(rest, open_noise), rest.filter("not known"), "article_id", "article_embeddings", params.eps, params.min_samples, params)
        labels, links = density.points.select(F.col("id").alias("article_id"), "label"), density.links
    else:
        labels = dbscan(rest, "article_id", "article_embeddings", params.eps, params.min_samples, params)
    grouped = labels.filter("label is not null").select("article_id", new_cluster_id(F.col("label"), as_of).alias("new_id"))
    decisions, _ = materialize(
        vectors.drop("article_embeddings", "known")
        .join(near, "article_id", "left")
        .join(grouped, "article_id", "left")
        .select(
            "source",
            "article_id",
            "article_published_date",
            F.coalesce("cluster_id", "new_id").alias("cluster_id"),
            F.when(F.col("cluster_id").isNotNull(), "assigned")
            .when(F.col("new_id").isNotNull(), "grouped")
            .otherwise("noise")
            .alias("stage"),
            "similarity",
        )
    )
    added = decisions.filter("cluster_id is not null").select(
        "cluster_id", "source", "article_id", F.lit(as_of).cast("bigint").alias("added_at")
    )
    if recent_members is not None:
        added = member_additions(added, recent_members)
    texts = pending.select("source", "article_id", "article_title", "article_summary", "article_content")

    def build() -> DataFrame:
        clustered, found = materialize(decisions.filter("cluster_id is not null").select("cluster_id", "source", "article_id", "stage"))
        # Only texts that are needed are dealt out, once, by the key that both steps share.
        if found["rows"] <= BROADCAST_IDS:
            # Other articles with the same hash drop out in the join.
            wanted = F.broadcast(clustered.select(F.xxhash64("article_id").alias("_hash")))
            needed = texts.withColumn("_hash", F.xxhash64("article_id")).join(wanted, "_hash", "left_semi")
        else:
            needed = texts.join(clustered.select("article_id"), "article_id", "left_semi")
        one = _one_per_article(needed.select(texts.columns)).withColumnRenamed("source", "_source")
        joining, _ = materialize(clustered.join(one, "article_id").filter("source = _source").drop("_source"))
        assigned, grouped = joining.filter("stage = 'assigned'"), joining.filter("stage = 'grouped'")
        grown = extend_clusters(state, assigned, as_of, params)
        fresh = build_clusters(grouped, as_of, params)
        if models.embed is not None or models.summarize_cluster is not None:
            if members is None or all_articles is None:
                raise ValueError("models of your own need the members and their articles")
            touched = members.join(assigned.select("cluster_id").distinct(), "cluster_id", "left_semi").select(added.columns)
            once, first = materialize(
                touched.unionByName(added.join(assigned.select("article_id"), "article_id", "left_semi").select(added.columns)),
                first=F.min("added_at"),
            )
            # An article joins a cluster within the lookback after its publication.
            since = (first["first"] or as_of) - params.article_lookback_s
            grown = apply_models(grown, member_articles(once, all_articles(since)), models, params.update_text, params)
            fresh = apply_models(fresh, grouped, models, "full", params)
        return grown.unionByName(fresh)

    left_open = _left_open(decisions, links, run_settings(params, models))
    return ClusterRun(decisions, added, run_metrics(decisions, state), left_open, seen["rows"] - seen["known"], seen["known"], build)


def run_settings(params: Params, models: Models) -> str:
    """What the noise of a run depends on, besides the articles and clusters."""
    parts = (params.assign_threshold, params.eps, params.min_samples, params.embed_dim, params.cluster_lookback_s, models.embed is None)
    return " ".join(map(str, parts))


def _stored_density(rest: DataFrame, open_noise: DataFrame | None) -> Density:
    """The open articles that are still there, as a state to grow: none is a core point."""
    kept = rest.filter("known").select(F.col("article_id").alias("id"), F.col("article_embeddings").cast("array<float>").alias("vec"))
    ids = kept.select("id")
    links = rest.select(F.col("article_id").alias("a"), F.col("article_id").alias("b")).limit(0)
    if open_noise is not None:
        links = open_noise.select(F.col("article_id").alias("a"), F.explode("neighbours").alias("b"))
        links = links.join(ids.toDF("a"), "a", "left_semi").join(ids.toDF("b"), "b", "left_semi").select("a", "b")
    each = links.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    points = kept.filter(usable(F.col("vec"))).join(each, "id", "left").select(
        "id", "vec", (F.lit(1) + F.coalesce("n", F.lit(0))).cast("bigint").alias("weight"), F.lit(False).alias("core"), F.lit(None).cast("string").alias("label")
    )
    return Density(points, links.filter("a < b"))


def _left_open(decisions: DataFrame, links: DataFrame | None, settings: str) -> DataFrame:
    noise = decisions.filter("stage = 'noise'").select("article_id")
    if links is None:
        with_links = noise.withColumn("neighbours", F.array().cast("array<string>"))
    else:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Noise has fewer than min_samples neighbours.
        near = both.join(noise.toDF("b"), "b", "left_semi").groupBy(F.col("a").alias("article_id")).agg(F.sort_array(F.collect_set("b")).alias("near"))
        with_links = noise.join(near, "article_id", "left").select("article_id", F.coalesce("near", F.array().cast("array<string>")).alias("neighbours"))
    return with_links.withColumn("settings", F.lit(settings))


def _one_per_article(rows: DataFrame) -> DataFrame:
    """One row per article id, the smallest by its other columns."""
    others = [c for c in rows.columns if c != "article_id"]
    one = rows.groupBy("article_id").agg(F.min(F.struct(*others)).alias("one"))
    return one.select("article_id", "one.*").select(rows.columns)


def run_metrics(decisions: DataFrame, state: DataFrame) -> DataFrame:
    """One row of counts: what was found, assigned, left over and newly grouped."""
    rows = decisions.select("stage", "cluster_id").unionByName(state.select(F.lit("cluster").alias("stage"), "cluster_id"))
    stage = F.col("stage")
    return rows.agg(
        F.count_if(stage != "cluster").alias("found_new"),
        F.count_if(stage == "cluster").alias("found_clusters"),
        F.count_if(stage == "assigned").alias("assigned"),
        F.count_if(stage.isin("grouped", "noise")).alias("unassigned"),
        F.count_distinct(F.when(stage == "grouped", F.col("cluster_id"))).alias("new_clusters"),
    )


def cluster_batch(store: Store, batch: int, now: int, params: Params = Params(), models: Models = Models()) -> dict:
    """Run one cluster batch against the stored tables; gives its metrics. Running it again changes nothing.

    Reads the publication days of the lookback and the clusters updated within
    theirs; writes only additions. ``searched`` articles were new to it, ``known`` ones noise
    of the run before, which are not compared with each other again.
    """
    as_of, upto = store.open_run("cluster", batch, now)
    articles = store.pending_articles(batch, upto, as_of - params.article_lookback_s)
    clusters = store.clusters(before=batch, since=as_of - params.cluster_lookback_s)
    with scratch(store.spark):
        open_noise, open_since = store.open_noise(batch, run_settings(params, models))
        run = cluster_run(
            articles,
            clusters,
            as_of,
            params,
            models,
            store.members(before=batch),
            lambda since: store.stored_articles(upto, since),
            # An article joins a cluster within the lookback after its publication.
            store.members(before=batch, since=as_of - params.article_lookback_s),
            open_noise,
            open_since,
        )
        store.add_clusters(run.changed, batch)
        store.add_members(run.members, batch)
        store.add_assignments(run.decisions.filter("cluster_id is not null"), batch)
        store.add_open_noise(run.left_open, batch)
        metrics = run.metrics.first().asDict() | {"searched": run.searched, "known": run.known}
    store.close_run("cluster", batch)
    return metrics
