"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG = T.StringType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


BLOCK = _struct(type=STRING, content=STRING, content_caption=STRING, src=STRING)

# `fetched_at` (epoch seconds) tells the copies of a page apart; it may be NULL or absent.
PAGES = _struct(page_id=LONG, url=STRING, html=STRING, fetched_at=LONG)

LISTING = _struct(
    listing_url=STRING,
    source=STRING,
    category=STRING,
    position=T.IntegerType(),
    article_url=STRING,
    title=STRING,
    thumbnail=STRING,
)

# Entries that were followed and whose page has not come yet.
REQUESTS = _struct(
    source=STRING,
    category=STRING,
    article_url=STRING,
    title=STRING,
    thumbnail=STRING,
    request_url=STRING,
    asked_at=LONG,
)

ARTICLES = _struct(
    source=STRING,
    article_id=STRING,
    article_title=STRING,
    article_url=STRING,
    article_thumbnail=STRING,
    article_image=STRING,
    article_content=T.ArrayType(BLOCK),
    article_published_date=LONG,
    article_category=STRING,
    article_summary=STRING,
    article_embeddings=T.ArrayType(T.FloatType()),
    cluster_id=STRING,
)

LEDGER = _struct(source=STRING, day=LONG, category=STRING, url=STRING)

STATS = _struct(source=STRING, metric=STRING, value=LONG)

# `lead_words`, `lead_id`, `key_sentences` and `text_counts` are what a refresh needs from the old
# members, so that it does not have to read their articles again.
CLUSTERS = _struct(
    cluster_id=STRING,
    cluster_title=STRING,
    cluster_content=STRING,
    cluster_embedding=T.ArrayType(T.FloatType()),
    last_updated=LONG,
    n_members=LONG,
    lead_words=LONG,
    lead_id=STRING,
    key_sentences=T.ArrayType(STRING),
    text_counts=T.ArrayType(LONG),
)

CLUSTER_MEMBERS = _struct(cluster_id=STRING, source=STRING, article_id=STRING, added_at=LONG)

ASSIGNMENTS = _struct(source=STRING, article_id=STRING, cluster_id=STRING)

# Articles that a cluster run left as noise, with those of the same kind that lie within eps of
# them, and the settings under which that holds.
OPEN = _struct(article_id=STRING, neighbours=T.ArrayType(STRING), settings=STRING)
