"""Registered queries: every operator over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storygraph.functions.dates import MONTHS_SQ, local_to_epoch, parse_day_month_year, parse_iso, parse_named_month, utc_day
from storygraph.functions.text import article_text, paragraphs, short_text, token_count, truncate_tokens
from storygraph.functions.urls import absolute_url, resolve_url, source_name, strip_quotes, style_url, url_category
from storygraph.functions.vectors import cosine_similarity
from storygraph.operators import clusters as C
from storygraph.operators.dbscan import dbscan, empty_density, eps_join, grow
from storygraph.operators.embed import embed_articles, fill_embeddings, hashed_vectors
from storygraph.operators.extract import article_records, extract_articles, listing_rows, shred_listings
from storygraph.operators.extract import extract_listing as listed_articles
from storygraph.operators.ledger import (
    ledger_additions,
    ledger_documents,
    ledger_of_day,
    ledger_rows,
    listing_quota,
    unseen_urls,
)
from storygraph.operators.nearest import assign_to_clusters
from storygraph.operators.profiles import PROFILES, BlockRule
from storygraph.operators.selection import new_articles, recent_clusters, rejected_articles, valid_articles
from storygraph.operators.stats import article_stats, stats_increment
from storygraph.operators.summarize import parse_summary, summarize_articles
from storygraph.params import DAY_S, Params
from storygraph.plans import adapters as A
from storygraph.plans.cluster import ClusterRun, cluster_run
from storygraph.plans.ingest import enrich, ingest_listing, stored_form
from storygraph.session import materialize, prepare, scratch_path
from storygraph.sources.tables import Store
from storygraph.streaming.jobs import cluster_stream, ledger_stream, running_stats

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Thresholds at which the driver's `embeddings` have neighbours.
EPS, NEAR = 0.6, 0.2
PART_CHARS = 2000
RUN = Params(article_lookback_s=10 * DAY_S)


def query(name: str) -> Callable[[Query], Query]:
    """Register a query under a name; it gets a session with this package's settings."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        REGISTRY[name] = run
        return fn

    return register


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.documents_as_articles(spark, sf_dir)


def _spread_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.documents_as_articles(spark, sf_dir, A.spread_table)


def _long(df: DataFrame, key: str, vector: str, name: str = "bucket") -> DataFrame:
    """Non-zero components of a vector column as rows."""
    return df.select(key, F.posexplode_outer(vector).alias(name, "value")).filter("value <> 0").select(
        key, F.col(name).cast("bigint").alias(name), F.col("value").cast("double").alias("value")
    )


# -- selection ---------------------------------------------------------------


@query("new_articles")
def new_articles_24h(spark, sf_dir):
    marked = _articles(spark, sf_dir).drop("cluster_id").join(
        A.table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit("old").alias("cluster_id")), "doc_id", "left"
    )
    return new_articles(marked, A.AS_OF).select("article_id", "source", "article_published_date")


@query("recent_clusters")
def recent_clusters_7d(spark, sf_dir):
    clusters = _articles(spark, sf_dir).groupBy(F.col("copy_id").alias("cluster_id")).agg(
        F.max("article_published_date").alias("last_updated")
    )
    return recent_clusters(clusters, A.AS_OF)


@query("valid_articles")
def valid_article_rows(spark, sf_dir):
    articles = _articles(spark, sf_dir)
    kept = valid_articles(articles).select("article_id", F.lit("ok").alias("reason"))
    return kept.unionByName(rejected_articles(articles).select("article_id", "reason"))


@query("store_articles")
def store_articles(spark, sf_dir):
    stored = stored_form(valid_articles(A.with_summary(_articles(spark, sf_dir))), A.AS_OF)
    return stored.select(
        "source",
        "article_id",
        "article_title",
        "article_url",
        F.size("article_content").cast("bigint").alias("n_blocks"),
        "article_published_date",
        "article_category",
        "article_summary",
        "cluster_id",
    )


# -- ledger, quota, counters ---------------------------------------------------


@query("ledger_today")
def ledger_today(spark, sf_dir):
    at = A.START + 14 * DAY_S + 3600
    return ledger_of_day(ledger_rows(A.feed(spark, sf_dir)), at, source="s1")


@query("ledger_sets")
def ledger_sets(spark, sf_dir):
    docs = ledger_documents(ledger_rows(A.feed(spark, sf_dir)), urls_per_chunk=20)
    return docs.withColumn("urls", F.array_join("urls", " "))


@query("ledger_upsert")
def ledger_upsert(spark, sf_dir):
    feed = A.feed(spark, sf_dir)
    stored = ledger_rows(feed.filter("value > 20"))
    return ledger_additions(ledger_rows(feed), stored)


@query("unseen_urls")
def unseen_feed_urls(spark, sf_dir):
    feed = A.feed(spark, sf_dir)
    today = ledger_of_day(ledger_rows(feed.filter("value > 20")), A.START + 29 * DAY_S)
    return unseen_urls(feed.withColumnRenamed("url", "article_url"), today).select("event_id", "source", "category")


@query("listing_quota")
def listing_quota_5(spark, sf_dir):
    entries = A.feed(spark, sf_dir).withColumnRenamed("url", "article_url")
    return listing_quota(entries).select("listing_url", "event_id")


@query("daily_url_dedup")
def daily_url_dedup(spark, sf_dir):
    return ledger_rows(A.feed(spark, sf_dir))


@query("article_stats")
def article_counters(spark, sf_dir):
    return article_stats(_articles(spark, sf_dir).select("source", "article_category"))


@query("feed_stats")
def feed_counters(spark, sf_dir):
    return article_stats(A.feed(spark, sf_dir).select("source", "category"), "category")


@query("stats_increment")
def stats_upsert(spark, sf_dir):
    rows = _articles(spark, sf_dir).select("source", "article_category", "article_published_date")
    stored = article_stats(rows.filter(F.col("article_published_date") < A.CUT))
    return stats_increment(stored, article_stats(rows.filter(F.col("article_published_date") >= A.CUT)))


# -- scalar functions ----------------------------------------------------------


@query("url_category")
def url_categories(spark, sf_dir):
    url = F.col("url")
    return A.table(spark, sf_dir, "pages").select(
        "page_id", url_category(url, -2).alias("next_to_last"), url_category(url, -1).alias("last")
    )


@query("absolute_url")
def absolute_urls(spark, sf_dir):
    path = F.regexp_replace("url", "^https:", "")
    return A.table(spark, sf_dir, "pages").select(
        "page_id",
        absolute_url(path, "https://syri.net").alias("if_relative"),
        absolute_url(path, "https://pamfleti.net", always=True).alias("always"),
    )


@query("resolve_url")
def resolved_urls(spark, sf_dir):
    links = {
        "absolute": F.col("url"),
        "host": F.lit("//cdn.example/x.jpg"),
        "rooted": F.lit("/lajm/9?a=b"),
        "beside": F.lit("lajm/9"),
        "query": F.lit("?page=2"),
        "above": F.lit("./../other"),
    }
    return A.table(spark, sf_dir, "pages").select("page_id", *[resolve_url(F.col("url"), link).alias(n) for n, link in links.items()])


@query("style_image_url")
def style_image_url(spark, sf_dir):
    quoted = F.concat(F.lit("background:url('"), F.col("url"), F.lit("') center, url(b)"))
    style = F.when(F.col("url").startswith("https"), quoted).otherwise(F.col("url"))
    return A.table(spark, sf_dir, "pages").select("page_id", strip_quotes(style_url(style)).alias("image"))


@query("source_name")
def source_names(spark, sf_dir):
    name = F.concat_ws("_", F.upper("source"), "lang")
    return A.table(spark, sf_dir, "documents").select("doc_id", source_name(name).alias("source"))


def _wall(spark, sf_dir) -> DataFrame:
    return A.table(spark, sf_dir, "events").select(
        "event_id", (F.col("ts") + F.expr(f"interval {A.SHIFT_DAYS} days")).cast("timestamp").alias("wall")
    )


@query("parse_date_iso")
def parse_date_iso(spark, sf_dir):
    text = F.concat(F.date_format("wall", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return _wall(spark, sf_dir).select("event_id", parse_iso(text).alias("epoch_s"))


@query("parse_date_named_month")
def parse_date_named_month(spark, sf_dir):
    names = F.array(*[F.lit(m) for m in MONTHS_SQ])
    text = F.concat_ws(
        " ",
        F.date_format("wall", "dd"),
        F.concat(F.element_at(names, F.month("wall")), F.lit(",")),
        F.date_format("wall", "yyyy HH:mm"),
    )
    return _wall(spark, sf_dir).select("event_id", parse_named_month(text).alias("epoch_s"))


@query("parse_date_dmy")
def parse_date_dmy(spark, sf_dir):
    date, time = F.date_format("wall", " dd/MM/yyyy"), F.date_format("wall", "HH:mm ")
    return _wall(spark, sf_dir).select("event_id", parse_day_month_year(date, time).alias("epoch_s"))


@query("local_to_epoch")
def local_time_to_epoch(spark, sf_dir):
    return _wall(spark, sf_dir).select(
        "event_id",
        local_to_epoch(F.col("wall")).alias("epoch_s"),
        utc_day(local_to_epoch(F.col("wall"))).alias("day"),
    )


@query("article_text")
def article_texts(spark, sf_dir):
    title, content = F.col("article_title"), F.col("article_content")
    return _articles(spark, sf_dir).select(
        "article_id", article_text(title, content).alias("full_text"), paragraphs(content).alias("paragraphs")
    )


@query("article_text_short")
def article_text_short(spark, sf_dir):
    rows = A.with_summary(_articles(spark, sf_dir))
    text = short_text(F.col("article_title"), F.col("article_summary"), F.col("article_content"))
    return rows.select("article_id", text.alias("short_text"))


@query("token_count")
def token_counts(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).cast("bigint").alias("n_tokens"))


@query("truncate_tokens")
def truncated_texts(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", truncate_tokens(F.col("text"), 50).alias("text"))


@query("summary_gate")
def summary_gate(spark, sf_dir):
    words = token_count(paragraphs(F.col("article_content")))
    return _articles(spark, sf_dir).select(
        "article_id", words.cast("bigint").alias("n_tokens"), (words > Params().summary_min_tokens).alias("summarised")
    )


@query("parse_summary_json")
def parse_summary_json(spark, sf_dir):
    text = F.to_json(F.struct(F.col("article_title").alias("cluster_title"), F.col("article_category").alias("cluster_content")))
    broken = F.when(F.size("article_content") == 0, F.left(text, F.lit(12))).otherwise(text)
    return _articles(spark, sf_dir).select("article_id", parse_summary(broken).alias("s")).select("article_id", "s.*")


# -- models --------------------------------------------------------------------


@query("embed_documents")
def embed_documents(spark, sf_dir):
    return _long(embed_articles(_spread_articles(spark, sf_dir)), "article_id", "article_embeddings")


@query("embedding_fill")
def embedding_fill(spark, sf_dir):
    stored = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("article_embeddings"))
    articles = A.with_summary(_spread_articles(spark, sf_dir)).drop("article_embeddings").join(stored, "doc_id", "left")
    return _long(fill_embeddings(articles, params=Params(embed_dim=64)), "article_id", "article_embeddings")


@query("summarize_documents")
def summarize_documents(spark, sf_dir):
    return summarize_articles(_articles(spark, sf_dir)).select("article_id", "article_summary")


@query("enrich_articles")
def enrich_articles(spark, sf_dir):
    rows = enrich(valid_articles(_spread_articles(spark, sf_dir)))
    used = F.size(F.filter("article_embeddings", lambda x: x != 0)).cast("bigint")
    return rows.select("article_id", "article_summary", used.alias("n_buckets"))


# -- vectors -------------------------------------------------------------------


def _vector_clusters(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Embeddings as articles, the first vector of each label as a cluster."""
    vectors = A.table(spark, sf_dir, "embeddings")
    first = F.min(F.struct("vec_id", "embedding")).alias("first")
    clusters = vectors.groupBy("label").agg(first).select(
        F.col("label").alias("cluster_id"),
        F.col("first.vec_id").alias("vec_id"),
        F.col("first.embedding").alias("cluster_embedding"),
        F.lit(A.AS_OF).cast("bigint").alias("last_updated"),
    )
    return vectors, clusters


@query("cosine_pairs")
def cosine_pairs(spark, sf_dir):
    vectors, clusters = _vector_clusters(spark, sf_dir)
    both = vectors.join(clusters.select(F.col("cluster_id").alias("label"), "cluster_embedding"), "label")
    sim = cosine_similarity(F.col("embedding"), F.col("cluster_embedding"))
    return both.select("vec_id", F.round(sim, 6).alias("similarity"))


def _assigned(spark, sf_dir, mode=None) -> DataFrame:
    vectors, clusters = _vector_clusters(spark, sf_dir)
    articles = vectors.join(clusters.select("vec_id"), "vec_id", "left_anti")
    return assign_to_clusters(articles, clusters, "vec_id", "embedding", NEAR, mode=mode)


@query("assign_nearest")
def assign_nearest(spark, sf_dir):
    rows = _assigned(spark, sf_dir).filter("cluster_id is not null")
    return rows.select("vec_id", "cluster_id", F.round("similarity", 6).alias("similarity"))


@query("assign_nearest_blocks")
def assign_nearest_blocks(spark, sf_dir):
    """The same by block pairs, the way taken when clusters are too many to broadcast."""
    rows = _assigned(spark, sf_dir, mode="blocks").filter("cluster_id is not null")
    return rows.select("vec_id", "cluster_id", F.round("similarity", 6).alias("similarity"))


@query("unassigned_articles")
def unassigned_articles(spark, sf_dir):
    rows = _assigned(spark, sf_dir).filter("cluster_id is null")
    return rows.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("similar_pairs")
def similar_pairs(spark, sf_dir):
    pairs = eps_join(A.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", EPS)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("dbscan_labels")
def dbscan_labels(spark, sf_dir):
    labels = dbscan(A.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", EPS, 2)
    return labels.select("vec_id", F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"))


@query("dbscan_core_border")
def dbscan_core_border(spark, sf_dir):
    """Three samples per core point: border points exist and join the lowest cluster."""
    labels = dbscan(A.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", EPS, 3)
    return labels.select("vec_id", F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"))


@query("dbscan_batches")
def dbscan_batches(spark, sf_dir):
    """Vectors in three batches, each compared with what came before it: the labels of one run over all."""
    return _grown(spark, sf_dir, 2)


@query("dbscan_batches_core_border")
def dbscan_batches_core_border(spark, sf_dir):
    return _grown(spark, sf_dir, 3)


def _grown(spark, sf_dir, min_samples) -> DataFrame:
    vectors = A.table(spark, sf_dir, "embeddings")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(3))
    state = empty_density(vectors, "vec_id")
    for k in range(3):
        state = grow(state, vectors.filter(part == k), "vec_id", "embedding", EPS, min_samples)
    labels = state.points.select(F.col("id").alias("vec_id"), "label")
    return vectors.select("vec_id").join(labels, "vec_id", "left").select("vec_id", F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"))


@query("cluster_labels")
def cluster_labels(spark, sf_dir):
    vectors = A.table(spark, sf_dir, "embeddings")
    labels = dbscan(vectors, "vec_id", "embedding", EPS, 2).filter("label is not null")
    return vectors.select("vec_id", F.col("label").alias("topic")).join(labels, "vec_id")


# -- cluster upkeep ------------------------------------------------------------


@query("cluster_text")
def cluster_text(spark, sf_dir):
    members = A.copy_member_articles(_articles(spark, sf_dir))
    passage = C.summary_passage(F.col("article_title"), F.col("article_content"))
    return C.cluster_text(
        members.select("cluster_id", "article_id", passage.alias("passage")), replace(Params(), text_part_chars=PART_CHARS)
    )


@query("cluster_embedding_text")
def cluster_embedding_text(spark, sf_dir):
    members = A.copy_member_articles(A.with_summary(_articles(spark, sf_dir)))
    passage = C.embedding_passage(F.col("article_title"), F.col("article_summary"), F.col("article_content"))
    return C.cluster_text(members.select("cluster_id", "article_id", passage.alias("passage")))


@query("cluster_embedding")
def cluster_embedding(spark, sf_dir):
    members = A.copy_member_articles(A.with_summary(_spread_articles(spark, sf_dir)))
    return _long(C.cluster_embedding(members), "cluster_id", "cluster_embedding")


@query("cluster_embedding_by_model")
def cluster_embedding_by_model(spark, sf_dir):
    """The way of a model passed in: vectors of the joined texts instead of summed counts."""
    members = A.copy_member_articles(A.with_summary(_spread_articles(spark, sf_dir)))
    return _long(C.embed_clusters(members, hashed_vectors(Params().embed_dim), "full"), "cluster_id", "cluster_embedding")


@query("cluster_summary")
def cluster_summary(spark, sf_dir):
    return C.cluster_summary(A.copy_member_articles(_articles(spark, sf_dir))).drop("key_sentences")


@query("cluster_members")
def cluster_members(spark, sf_dir):
    members = A.copy_members(_articles(spark, sf_dir)).withColumn("added_at", F.lit(A.AS_OF).cast("bigint"))
    lists = C.member_lists(members, per_chunk=2)
    return lists.withColumn("articles", F.array_join("articles", " "))


@query("member_additions")
def member_additions(spark, sf_dir):
    members = A.copy_members(_articles(spark, sf_dir))
    return C.member_additions(members, members.filter(F.col("added_at") < A.CUT))


@query("cluster_member_articles")
def cluster_member_articles(spark, sf_dir):
    articles = A.with_summary(_articles(spark, sf_dir))
    rows = C.member_articles(A.copy_members(articles), valid_articles(articles))
    return rows.select(
        "cluster_id",
        "source",
        "article_id",
        "added_at",
        "article_title",
        "article_summary",
        F.size("article_content").cast("bigint").alias("n_blocks"),
    )


TEXT_FIELDS = ["cluster_id", "cluster_title", "cluster_content", "last_updated", "n_members", "lead_words", "lead_id"]


@query("new_clusters")
def new_clusters(spark, sf_dir):
    members = A.copy_member_articles(A.with_summary(_spread_articles(spark, sf_dir)))
    return C.build_clusters(members, A.AS_OF).select(TEXT_FIELDS)


def _history_and_additions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Clusters of the copies published before the cut, and the copies published after it."""
    articles, _ = materialize(A.with_summary(_spread_articles(spark, sf_dir)))
    old = articles.filter(F.col("article_published_date") < A.CUT)
    history = C.build_clusters(A.copy_member_articles(old), A.HISTORY_AT)
    fresh = articles.filter(F.col("article_published_date") >= A.CUT).withColumn("cluster_id", F.col("copy_id"))
    return history, fresh


@query("updated_clusters")
def updated_clusters(spark, sf_dir):
    history, fresh = _history_and_additions(spark, sf_dir)
    return C.extend_clusters(history, fresh, A.AS_OF).select(TEXT_FIELDS)


@query("updated_cluster_embedding")
def updated_cluster_embedding(spark, sf_dir):
    history, fresh = _history_and_additions(spark, sf_dir)
    return _long(C.extend_clusters(history, fresh, A.AS_OF), "cluster_id", "cluster_embedding")


@query("upserted_clusters")
def upserted_clusters(spark, sf_dir):
    history, fresh = _history_and_additions(spark, sf_dir)
    return C.upsert_clusters(history, C.extend_clusters(history, fresh, A.AS_OF)).select("cluster_id", "last_updated", "n_members")


@query("stored_clusters")
def stored_clusters(spark, sf_dir):
    """Two batches of cluster rows written and read back: the newest row of each counts."""
    history, fresh = _history_and_additions(spark, sf_dir)
    store = Store(spark, scratch_path(spark))
    history, _ = materialize(history)
    store.add_clusters(history, 0)
    store.add_clusters(C.extend_clusters(store.clusters(before=1), fresh, A.AS_OF), 1)
    return store.clusters().select("cluster_id", "last_updated", "n_members")


@query("stored_articles")
def stored_articles(spark, sf_dir):
    """Articles in one batch, what clusters they joined in another."""
    articles, store = _articles(spark, sf_dir), Store(spark, scratch_path(spark))
    store.add_articles(articles.drop("doc_id", "copy_id"), 0)
    joined = A.copy_members(articles).withColumnRenamed("added_at", "article_published_date")
    store.add_assignments(joined, 1)
    return store.articles().select("source", "article_id", "cluster_id")


@query("stored_members")
def stored_members(spark, sf_dir):
    """The second batch meets all candidates and adds only those that are not members yet."""
    members, store = A.copy_members(_articles(spark, sf_dir)), Store(spark, scratch_path(spark))
    store.add_members(members.filter(F.col("added_at") < A.CUT), 0)
    store.add_members(C.member_additions(members, store.members(before=1)), 1)
    return store.members()


@query("stored_counters")
def stored_counters(spark, sf_dir):
    rows, store = _articles(spark, sf_dir).select("source", "article_category", "article_published_date"), Store(spark, scratch_path(spark))
    store.add_stats(article_stats(rows.filter(F.col("article_published_date") < A.CUT)), 0)
    store.add_stats(article_stats(rows.filter(F.col("article_published_date") >= A.CUT)), 1)
    return store.stats()


@query("stored_ledger")
def stored_ledger(spark, sf_dir):
    feed, store = A.feed(spark, sf_dir), Store(spark, scratch_path(spark))
    store.add_ledger(ledger_rows(feed.filter("value > 20")), 0)
    store.add_ledger(ledger_additions(ledger_rows(feed), store.ledger(before=1)), 1)
    return store.ledger()


@query("articles_with_cluster")
def articles_with_cluster(spark, sf_dir):
    articles = _articles(spark, sf_dir)
    rows = C.with_cluster(articles.drop("doc_id", "copy_id"), A.copy_members(articles))
    return rows.select("source", "article_id", "cluster_id")


def _run(spark, sf_dir, copies: int = 1) -> ClusterRun:
    """History: copies published before the cut. Run: everything published since, at the default thresholds."""
    articles, _ = materialize(embed_articles(A.with_summary(_spread_articles(spark, sf_dir))))
    old = articles.filter(F.col("article_published_date") < A.CUT)
    # Read three times, so the look-up of the copies is written out.
    members, _ = materialize(A.copy_member_articles(old).select("cluster_id", "article_id", "article_title", "article_summary", "article_content"))
    clusters, _ = materialize(C.build_clusters(members, A.HISTORY_AT))
    stored = articles.drop("doc_id", "copy_id")
    for _ in range(copies - 1):
        stored = stored.unionByName(articles.drop("doc_id", "copy_id"))
    return cluster_run(stored, clusters, A.AS_OF, RUN)


@query("cluster_run")
def cluster_run_decisions(spark, sf_dir):
    return _run(spark, sf_dir).decisions.select("article_id", "stage", "cluster_id", F.round("similarity", 6).alias("similarity"))


@query("cluster_run_repeated_keys")
def cluster_run_repeated_keys(spark, sf_dir):
    """Every article is stored twice: decisions and members are those of single rows."""
    rows = _run(spark, sf_dir, copies=2).decisions
    return rows.select("article_id", "stage", "cluster_id", F.round("similarity", 6).alias("similarity"))


@query("cluster_run_changes")
def cluster_run_changes(spark, sf_dir):
    return _run(spark, sf_dir).changed.select(TEXT_FIELDS)


@query("run_metrics")
def run_metrics(spark, sf_dir):
    return _run(spark, sf_dir).metrics


# -- extraction ----------------------------------------------------------------


def _blocks(spark, sf_dir, profile) -> DataFrame:
    pages = A.spread_table(spark, sf_dir, "pages")
    return extract_articles(pages, [profile]).select("url", F.posexplode("article_content").alias("position", "b")).select(
        "url", F.col("position").cast("bigint").alias("position"), F.col("b.type").alias("type"), F.col("b.content").alias("content")
    )


@query("extract_listing")
def extract_listing(spark, sf_dir):
    rows = listing_rows(shred_listings(A.spread_table(spark, sf_dir, "pages"), [A.WEB]), [A.WEB])
    return rows.select(
        "listing_url", "category", F.col("position").cast("bigint").alias("position"), "article_url", "title", "thumbnail"
    )


@query("extract_blocks")
def extract_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir, A.WEB)


@query("first_text_blocks")
def first_text_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir, replace(A.WEB, text_mode="first"))


@query("joined_text_blocks")
def joined_text_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir, replace(A.WEB, text_mode="join"))


@query("classify_blocks")
def classify_blocks(spark, sf_dir):
    """Rules by tag and class part, link before text in list items, unmatched elements dropped."""
    site = replace(
        A.WEB,
        content="nav li, div.ad, article > h1, article p, footer",
        element_picks=A.WEB.element_picks | {"iframe": ("a", "@href")},
        rules=(
            BlockRule("p", "text", "paragraph"),
            BlockRule("p", "iframe", "iframe"),
            BlockRule("li", "iframe", "iframe"),
            BlockRule("li", "text", "paragraph"),
            BlockRule("h1", "image", "image", required=False),
            BlockRule("div", "text", "video", class_part="ad", key="src"),
        ),
    )
    rows = extract_articles(A.spread_table(spark, sf_dir, "pages"), [site])
    return rows.select("url", F.posexplode("article_content").alias("position", "b")).select(
        "url", F.col("position").cast("bigint").alias("position"), "b.type", "b.content", "b.src"
    )


@query("gallery_blocks")
def gallery_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir, replace(A.WEB, gallery=("nav a", "@href")))


@query("article_image")
def article_image(spark, sf_dir):
    return extract_articles(A.spread_table(spark, sf_dir, "pages"), [A.WEB]).select("url", "article_image")


def _content():
    """The blocks of an article, one a line."""
    return F.array_join(F.transform("article_content", lambda b: F.concat_ws(" ", b["type"], b["content"])), "\n")


@query("article_records")
def article_page_records(spark, sf_dir):
    pages = A.spread_table(spark, sf_dir, "pages")
    rows = article_records(A.page_listing(pages), pages, [A.WEB])
    return rows.select(
        "article_url", "article_title", "article_category", _content().alias("content"), "cluster_id"
    )


def _site(spark, sf_dir, site: str) -> DataFrame:
    """Documents in the layout of a site, listed, followed and extracted back in full."""
    profile = next(p for p in PROFILES if p.source == site)
    pages = A.site_pages(A.spread_table(spark, sf_dir, "documents"), site)
    rows = article_records(listed_articles(pages, [profile]), pages, [profile])
    return rows.select(
        "article_url", "article_title", "article_thumbnail", "article_image", _content().alias("content"), "article_published_date", "article_category"
    )


@query("site_lapsi")
def site_lapsi(spark, sf_dir):
    return _site(spark, sf_dir, "lapsi")


@query("site_pamfleti")
def site_pamfleti(spark, sf_dir):
    return _site(spark, sf_dir, "pamfleti")


@query("site_syri")
def site_syri(spark, sf_dir):
    return _site(spark, sf_dir, "syri")


@query("article_records_recrawled")
def recrawled_page_records(spark, sf_dir):
    """Every page is there twice: an older copy without content must not count, nor make a second article."""
    pages = A.spread_table(spark, sf_dir, "pages")
    old = pages.withColumn("html", F.lit("<html><article><p>old</p></article></html>")).withColumn("fetched_at", F.lit(1).cast("bigint"))
    both = old.unionByName(pages.withColumn("fetched_at", F.lit(2).cast("bigint")))
    rows = article_records(A.page_listing(pages), both, [A.WEB])
    return rows.select(
        "article_url", "article_title", "article_category", _content().alias("content"), "cluster_id"
    )


INGESTED = ["source", "article_id", "article_url", "article_category", "content", "article_summary"]


def _seen_http(listing: DataFrame) -> DataFrame:
    return ledger_rows(
        listing.filter(F.col("article_url").startswith("http:")).select(
            "source", "category", F.col("article_url").alias("url"), F.lit(A.AS_OF).cast("bigint").alias("ts_s")
        )
    )


@query("ingest_two_batches")
def ingest_two_batches(spark, sf_dir):
    """The listing in one batch without any page, all pages in the next: the same articles as in one batch."""
    pages = A.spread_table(spark, sf_dir, "pages")
    listing = A.page_listing(pages)
    ledger = _seen_http(listing)
    first = ingest_listing(listing, pages.limit(0), ledger, A.AS_OF, profiles=[A.WEB])
    second = ingest_listing(listing.limit(0), pages, ledger, A.AS_OF, profiles=[A.WEB], waiting=first.waiting)
    rows = first.articles.unionByName(second.articles)
    return rows.withColumn("content", _content()).select(INGESTED)


@query("ingest_run")
def ingest_run(spark, sf_dir):
    pages = A.spread_table(spark, sf_dir, "pages")
    listing = A.page_listing(pages)
    run = ingest_listing(listing, pages, _seen_http(listing), A.AS_OF, profiles=[A.WEB])
    return run.articles.withColumn("content", _content()).select(INGESTED)


# -- streams -------------------------------------------------------------------


def _streamed_feed(spark, sf_dir) -> DataFrame:
    """Events in four parts, each with rows of all days: most rows of the later ones come late.

    Each part is written by as many tasks as read it; the stream takes a quarter of the files at a time.
    """
    events, folder = A.table(spark, sf_dir, "events"), scratch_path(spark)
    part = F.pmod(F.coalesce("event_id", F.lit(0)), F.lit(4))
    for k in range(4):
        events.filter(part == 3 - k).write.mode("append").parquet(folder)
    files = len(spark.read.schema(events.schema).parquet(folder).inputFiles())
    return A.feed_columns(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, -(-files // 4))).parquet(folder))


def _drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and read back everything it gave out."""
    spark, folder = stream.sparkSession, scratch_path(stream.sparkSession)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(stream.columns)


@query("stream_url_dedup")
def stream_url_dedup(spark, sf_dir):
    store = Store(spark, scratch_path(spark))
    ledger_stream(_streamed_feed(spark, sf_dir), store, scratch_path(spark), once=True).awaitTermination()
    return store.ledger()


@query("stream_stats")
def stream_stats(spark, sf_dir):
    """Running counters; the newest value of each is the largest."""
    rows = _drain(running_stats(_streamed_feed(spark, sf_dir)), "update")
    return rows.groupBy("source", "metric").agg(F.max("value").alias("value"))


@query("cluster_stream_ticks")
def cluster_stream_ticks(spark, sf_dir):
    """Two ticks of the periodic run: vectors of even ids are stored before the first, all others before the second.

    No article is near enough to a cluster to be assigned, so both runs group: the second one
    what is new and what the first left as noise.
    """
    vectors = A.table(spark, sf_dir, "embeddings")
    stored = A.vector_articles(vectors)
    store, ticks, state = Store(spark, scratch_path(spark)), scratch_path(spark), scratch_path(spark)
    params = Params(assign_threshold=2.0, eps=EPS, embed_dim=64)
    for batch in (0, 1):
        store.open_run("ingest", batch, A.AS_OF)
        store.add_articles(stored.filter(F.pmod("vec_id", F.lit(2)) == batch).drop("vec_id"), batch)
        store.close_run("ingest", batch)
        spark.range(1).write.mode("append").parquet(ticks)
        pace = spark.readStream.schema("id long").parquet(ticks)
        at = A.AS_OF + 10 * batch
        cluster_stream(pace, store, state, params, clock=lambda at=at: at, once=True).awaitTermination()
    return store.members().select(F.col("article_id").cast("long").alias("vec_id"), "cluster_id", "added_at")
