import pandas as pd
from pyspark.sql import functions as F

from storygraph.operators.embed import embed_articles, fill_embeddings, ngram_counts
from storygraph.operators.ledger import (
    first_requests,
    ledger_additions,
    ledger_documents,
    ledger_of_day,
    ledger_rows,
    listing_quota,
    unseen_urls,
)
from storygraph.operators.models import PerWorker
from storygraph.operators.selection import new_articles, recent_clusters, rejected_articles, valid_articles
from storygraph.operators.stats import article_stats, stats_increment
from storygraph.operators.summarize import summarize_articles
from storygraph.params import DAY_S, Params
from storygraph.schemas import ARTICLES, LEDGER, LISTING

NOW = 1729513800
TODAY = 1729468800


def listing(spark, urls):
    rows = [("L", "s", "c", i, u, f"t{i}", None) for i, u in enumerate(urls, 1)]
    return spark.createDataFrame(rows, LISTING)


def test_quota_counts_unseen_entries_after_the_ledger(spark):
    entries = listing(spark, [f"u{i}" for i in range(1, 9)])
    stored = [("s", TODAY, "c", "u2"), ("s", TODAY, "c", "u3"), ("s", TODAY, "other", "u4"), ("s", TODAY - DAY_S, "c", "u5")]
    ledger = spark.createDataFrame(stored, LEDGER)
    kept = listing_quota(unseen_urls(entries, ledger_of_day(ledger, NOW)))
    assert sorted(r.position for r in kept.collect()) == [1, 4, 5, 6, 7]
    wide = listing_quota(unseen_urls(entries, ledger_of_day(ledger, NOW, Params(dedup_days=2))))
    assert sorted(r.position for r in wide.collect()) == [1, 4, 6, 7, 8]


def test_repeated_entry_uses_its_place_and_is_asked_once(spark):
    kept = first_requests(listing_quota(listing(spark, ["a", "a", "b", "c", "d", "e"])))
    assert sorted((r.article_url, r.position) for r in kept.collect()) == [("a", 1), ("b", 3), ("c", 4), ("d", 5)]


def test_quota_keeps_five_per_task_before_the_shuffle(spark):
    plan = listing_quota(listing(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_ledger_is_a_set_per_utc_day(spark):
    seen = spark.createDataFrame(
        [("s", "c", "u", NOW), ("s", "c", "u", NOW + 60), ("s", "c", "u", NOW + DAY_S), ("s", "c", "v", NOW)],
        "source string, category string, url string, ts_s bigint",
    )
    rows = ledger_rows(seen)
    assert rows.count() == 3
    stored = rows.filter("url = 'u'")
    assert [r.url for r in ledger_additions(rows, stored).collect()] == ["v"]
    assert ledger_additions(rows, rows).isEmpty()
    chunks = ledger_documents(rows, urls_per_chunk=1).collect()
    assert sorted(u for r in chunks for u in r.urls) == ["u", "u", "v"]


def test_counters(spark):
    articles = spark.createDataFrame(
        [("s", "politike"), ("s", "politike"), ("s", "aktualitet")], "source string, article_category string"
    )
    stats = article_stats(articles)
    assert {(r.source, r.metric): r.value for r in stats.collect()} == {
        ("s", "total_articles"): 3, ("s", "category_politike"): 2, ("s", "category_aktualitet"): 1,
    }
    both = stats_increment(stats, stats.filter("metric = 'total_articles'"))
    assert {r.metric: r.value for r in both.collect()}["total_articles"] == 6


def article(aid, title="t", content=(("paragraph", "x", None, None),), date=NOW, cluster=None, summary=None, vector=None):
    return ("s", aid, title, f"u{aid}", None, None, list(content), date, "c", summary, vector, cluster)


def test_validation_and_lookback(spark):
    rows = [
        article("full"), article("empty", content=()), article("untitled", title=None), article("undated", date=None),
        article("edge", date=NOW - DAY_S), article("old", date=NOW - DAY_S - 1), article("taken", cluster="k"),
    ]
    df = spark.createDataFrame(rows, ARTICLES)
    assert {r.article_id: r.reason for r in rejected_articles(df).collect()} == {
        "empty": "empty_content", "untitled": "missing_title",
    }
    new = {r.article_id for r in new_articles(valid_articles(df), NOW).collect()}
    assert new == {"full", "edge"}
    clusters = spark.createDataFrame([("a", NOW - 604800), ("b", NOW - 604801)], "cluster_id string, last_updated bigint")
    assert [r.cluster_id for r in recent_clusters(clusters, NOW).collect()] == ["a"]


def test_counts_add_up_over_passages():
    a, b = "one two three four", "five six"
    assert (ngram_counts(a + "\n\n" + b, 32) == ngram_counts(a, 32) + ngram_counts(b, 32)).all()
    assert ngram_counts("", 8).sum() == 0


def test_stored_embedding_is_kept_and_model_sees_the_rest(spark):
    rows = [article("has", vector=[1.0, 0.0]), article("none"), article("nothing", title=None)]

    def model(texts):
        assert list(texts) == ["t x"]
        return texts.map(lambda t: [0.0, 2.0])

    got = fill_embeddings(spark.createDataFrame(rows, ARTICLES).coalesce(1), model)
    assert {r.article_id: r.article_embeddings for r in got.collect()} == {
        "has": [1.0, 0.0], "none": [0.0, 2.0], "nothing": None,
    }


def test_only_long_texts_are_summarised_and_failures_are_null(spark):
    def block(n):
        return (("paragraph", "w " * n, None, None),)

    rows = [article("short", content=block(300)), article("long", content=block(301)), article("bad", content=block(400))]

    def model(texts):
        assert texts.notna().all()
        if (texts.str.len() > 700).any():
            raise ValueError("no answer")
        return [f"{len(t.split())} words" for t in texts]

    got = summarize_articles(spark.createDataFrame(rows, ARTICLES).coalesce(1), model)
    assert {r.article_id: r.article_summary for r in got.collect()} == {"short": None, "long": "301 words", "bad": None}
    plain = summarize_articles(spark.createDataFrame(rows, ARTICLES)).filter(F.col("article_summary").isNotNull())
    assert plain.count() == 2


def test_a_tokenizer_decides_gate_and_cut_and_models_are_set_up_once_per_worker(spark):
    class Letters:
        """A tokenizer of single letters; defined here so that workers get it with the function."""

        def count(self, texts):
            return [len(t.replace(" ", "")) for t in texts]

        def cut(self, texts, limit):
            return [t[:limit] for t in texts]

    rows = [article("one", content=(("paragraph", "abc", None, None),)), article("two", content=(("paragraph", "abcdef", None, None),))]
    df = spark.createDataFrame(rows, ARTICLES)

    def factory():
        return lambda texts: [t.upper() for t in texts]

    model = PerWorker(factory)
    got = summarize_articles(df, model, Params(summary_min_tokens=4), Letters())
    assert {r.article_id: r.article_summary for r in got.collect()} == {"one": None, "two": "ABCDEF"}
    assert list(model(pd.Series(["x"]))) == ["X"] and model._model is model._model is not None
    lengths = embed_articles(df, lambda texts: texts.map(lambda t: [float(len(t))]), Params(max_tokens=3), Letters())
    assert {tuple(r.article_embeddings) for r in lengths.collect()} == {(3.0,)}
