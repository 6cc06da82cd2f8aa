"""The driver tables seen as news data; the oracle SQL mirrors these definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storygraph.functions.dates import MONTHS_SQ
from storygraph.functions.text import paragraphs, token_count
from storygraph.functions.vectors import let
from storygraph.operators.profiles import PROFILES, BlockRule, SiteProfile
from storygraph.operators.summarize import lead_sentences
from storygraph.params import DAY_S, Params
from storygraph.session import materialize

START = 1704067200  # 2024-01-01
AS_OF = 1706659200  # 2024-01-31
CUT = AS_OF - 10 * DAY_S  # articles before it are history, the others are new
HISTORY_AT = AS_OF - 5 * DAY_S  # when the history clusters were last updated
SHIFT_DAYS = 300  # moves event times across the autumn clock change


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same for work in Python: a table that is read by fewer tasks than there are cores is dealt out to all of them.

    Larger data is left as the scan splits it, without a shuffle.
    """
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def documents_as_articles(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Articles: first line as title, further lines as blocks (short lines as images)."""
    lines = F.split("text", "\n")
    none = F.lit(None).cast("string")

    def block(line):
        kind = F.when(F.length(line) >= 12, "paragraph").otherwise("image")
        return F.struct(kind.alias("type"), line.alias("content"), none.alias("content_caption"), none.alias("src"))

    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        F.sha2(F.col("doc_id").cast("string"), 256).alias("article_id"),
        F.element_at(lines, 1).alias("article_title"),
        F.concat(F.lit("https://site.example/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("article_url"),
        none.alias("article_thumbnail"),
        none.alias("article_image"),
        F.transform(rest, block).alias("article_content"),
        (F.lit(START) + (F.col("doc_id") * 1000003) % 2592000).alias("article_published_date"),
        F.col("lang").alias("article_category"),
        none.alias("article_summary"),
        F.lit(None).cast("array<float>").alias("article_embeddings"),
        none.alias("cluster_id"),
        F.md5("text").alias("copy_id"),
    )


def vector_articles(vectors: DataFrame) -> DataFrame:
    """Articles around given vectors, named by their id, all published at the start of the last day."""
    none = F.lit(None).cast("string")
    name = F.col("vec_id").cast("string")
    return vectors.select(
        "vec_id",
        F.lit("vectors").alias("source"),
        name.alias("article_id"),
        F.concat(F.lit("Vector "), name).alias("article_title"),
        F.concat(F.lit("https://site.example/v/"), name).alias("article_url"),
        none.alias("article_thumbnail"),
        none.alias("article_image"),
        F.array(F.struct(F.lit("paragraph").alias("type"), name.alias("content"), none.alias("content_caption"), none.alias("src"))).alias("article_content"),
        F.lit(AS_OF).cast("bigint").alias("article_published_date"),
        F.col("label").cast("string").alias("article_category"),
        none.alias("article_summary"),
        F.col("embedding").cast("array<float>").alias("article_embeddings"),
        none.alias("cluster_id"),
    )


def with_summary(articles: DataFrame) -> DataFrame:
    """Articles with the built-in summary where the text is long enough."""
    summary = let(paragraphs(F.col("article_content")), lambda body: F.when(token_count(body) > Params().summary_min_tokens, lead_sentences(body)))
    return articles.withColumn("article_summary", summary)


def copy_members(articles: DataFrame) -> DataFrame:
    """Cluster members: all articles of a text that occurs at least twice, under its digest."""
    return articles.join(repeated_copies(articles), "copy_id", "left_semi").select(
        F.col("copy_id").alias("cluster_id"), "source", "article_id", F.col("article_published_date").alias("added_at")
    )


def copy_member_articles(articles: DataFrame) -> DataFrame:
    """The same with titles and texts."""
    return articles.join(repeated_copies(articles), "copy_id", "left_semi").withColumn("cluster_id", F.col("copy_id"))


def repeated_copies(articles: DataFrame) -> DataFrame:
    """(copy_id) of the texts that occur at least twice.

    Written out first: where they are few, Spark sees it and broadcasts them, instead of dealing all texts by their digest.
    """
    twice, _ = materialize(articles.groupBy("copy_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("copy_id"))
    return twice


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing entries: events of three sources; a listing is one source, category and UTC day."""
    return feed_columns(table(spark, sf_dir, "events"))


def feed_columns(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    source = F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string"))
    return events.select(
        "event_id",
        source.alias("source"),
        F.col("event_type").alias("category"),
        F.col("props").alias("url"),
        F.col("event_id").alias("position"),
        F.unix_timestamp(ts).alias("ts_s"),
        ts.alias("ts"),
        F.col("value"),
        F.concat_ws("/", source, "event_type", F.date_format(ts, "yyyy-MM-dd")).alias("listing_url"),
    )


WEB = SiteProfile(
    source="web",
    hosts=("http://", "https://"),
    listings=(),
    category_piece=-2,
    card="nav li",
    link=("a", "@href"),
    title=("a", "texts"),
    image=("a", "@href"),
    image_prefix="https://site.example",
    content="article p",
    rules=(BlockRule("p", "text", "paragraph"), BlockRule("p", "iframe", "iframe"), BlockRule("p", "image", "image")),
    text_mode="concat",
    lead_image=("article img", "@src"),
    paragraph_image=("nav a", "@href"),
    date=("time", "@datetime"),
    date_form="iso",
)


def site_pages(docs: DataFrame, site: str) -> DataFrame:
    """Each document as a card of a listing of the site, and as an article page in the site's layout.

    Lines after the first are paragraphs. Every document has a crawl of its own (``fetched_at``).
    """

    def escaped(text):
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(char), F.lit(entity))
        return text

    def html(*parts):
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    key = F.col("doc_id").cast("string")
    lines = F.split(escaped(F.col("text")), "\n")
    title = F.element_at(lines, 1)
    body = F.array_join(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: html("<p>", x, "</p>")), "")
    at = F.timestamp_seconds(F.lit(START) + (F.col("doc_id") * 1000003) % 2592000)
    if site == "lapsi":
        link = html("https://lapsi.al/d", key)
        url = link
        card = html('<div id="content"><article><img src="/t', key, '.jpg"><div class="post-content-wrapper"><a href="', link, '">', title, "</a></div></article></div>")
        page = html(
            '<div class="post-preview"><img src="https://lapsi.al/i', key, '.jpg"></div><div class="entry-meta"><time class="published" datetime="',
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), '+00:00">x</time></div><div class="entry-content">', body, "</div>",
        )
    elif site == "pamfleti":
        url = html("https://pamfleti.net/d", key)
        card = html(
            '<div class="c-flexy shtoketu"><article class="a-card"><a href="/d', key, '"><img class="a-media_img" data-src="t', key,
            '.jpg"></a><h3 class="a-head">', title, "</h3></article></div>",
        )
        page = html(
            '<span class="a-date">', F.date_format(at, "dd"), f" {MONTHS_SQ[0]}, ", F.date_format(at, "yyyy HH:mm"),
            '</span><div class="all-content"><div class="horizontal imazhiim"><img src="i', key, '.jpg"></div>', body, "</div>",
        )
    else:
        url = html("https://www.syri.net/lajm/", key)
        styled = html('<div class="categ-lg" style="background:url(\'/t', key, ".jpg') center\"></div>")
        plain = html('<div class="img-cover" data-original="https://cdn.example/t', key, '.jpg"></div>')
        card = html('<div class="categ-left"><a href="/lajm/', key, '"><h1>', title, "</h1></a>", F.when(F.col("doc_id") % 2 == 0, styled).otherwise(plain), "</div>")
        page = html(
            '<div class="prime-left readmore"><img src="/i', key, '.jpg"><span class="date"><strong> ', F.date_format(at, "HH:mm"), " </strong><strong>",
            F.date_format(at, "dd/MM/yyyy"), '</strong></span><div class="readmore-text-here">', body,
            '</div></div><div class="fotogaleri"><img src="g', key, '.jpg"></div>',
        )
    profile = next(p for p in PROFILES if p.source == site)
    crawl = F.col("doc_id").alias("fetched_at")
    cards = docs.select(F.lit(profile.listings[0]).alias("url"), card.alias("html"), crawl)
    return cards.unionByName(docs.select(url.alias("url"), page.alias("html"), crawl))


def page_listing(pages: DataFrame) -> DataFrame:
    """Every page as an entry of the listing of its host."""
    return pages.select(
        F.split_part("url", F.lit("/"), F.lit(3)).alias("listing_url"),
        F.lit("web").alias("source"),
        F.split_part("url", F.lit("/"), F.lit(4)).alias("category"),
        F.col("page_id").cast("int").alias("position"),
        F.col("url").alias("article_url"),
        F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("thumbnail"),
    )
