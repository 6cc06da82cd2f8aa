import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from storygraph.operators import clusters as C
from storygraph.operators.models import Models
from storygraph.params import DAY_S, Params
from storygraph.plans.cluster import cluster_batch, cluster_run
from storygraph.plans.ingest import ingest_batch, stored_form
from storygraph.schemas import ARTICLES, CLUSTERS
from storygraph.schemas import PAGES as PAGES_SCHEMA
from storygraph.sources.pages import read_pages, stream_pages
from storygraph.sources.tables import Store
from storygraph.streaming.jobs import cluster_stream, ingest_stream, ledger_stream, running_stats
from tests.fixtures import PAGES
from tests.test_tables import article

NOW = 1729520000
DIM = Params(embed_dim=64)


def text(words):
    return (("paragraph", words, None, None),)


FLOOD = "water rose over the bridge in the old town on monday night"
VOTE = "parliament votes on the budget after a long debate with the opposition"
SPORT = "the team won the final match with two goals in extra time"


def articles(spark, rows):
    return spark.createDataFrame(rows, ARTICLES)


def start(spark):
    return articles(spark, [
        article("a1", "Flood", text(FLOOD), NOW - 100), article("a2", "Flood", text(FLOOD + " again"), NOW - 90),
        article("a3", "Vote", text(VOTE), NOW - 80), article("a4", "Sport", text(SPORT), NOW - DAY_S - 1),
    ])


def save(store, df, batch):
    store.open_run("ingest", batch, NOW)
    store.add_articles(df, batch)
    store.close_run("ingest", batch)


def state(store):
    clusters = sorted((r.n_members, r.cluster_title, r.last_updated, r.text_counts) for r in store.clusters().collect())
    members = sorted((r.cluster_id, r.article_id, r.added_at) for r in store.members().collect())
    return clusters, members, sorted((r.article_id, r.cluster_id) for r in store.articles().select("article_id", "cluster_id").collect() if r.cluster_id)


def test_runs_assign_group_and_retry_noise(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    save(store, start(spark), 0)
    first = cluster_batch(store, 0, NOW, DIM)
    assert first == {"found_new": 3, "found_clusters": 0, "assigned": 0, "unassigned": 3, "new_clusters": 1, "searched": 3, "known": 0}
    taken = {r.article_id: r.cluster_id for r in store.articles().collect()}
    assert taken["a1"] == taken["a2"] is not None and taken["a3"] is None and taken["a4"] is None

    # The noise of the first run meets its match; a third flood report joins the cluster.
    more = [article("b1", "Vote", text(VOTE + " today"), NOW), article("b2", "Flood", text(FLOOD), NOW)]
    save(store, articles(spark, more), 1)
    params = Params(embed_dim=64, update_text="full")
    second = cluster_batch(store, 1, NOW + 10, params)
    assert second == {"found_new": 3, "found_clusters": 1, "assigned": 1, "unassigned": 2, "new_clusters": 1, "searched": 2, "known": 1}
    before = state(store)
    assert [c[0] for c in before[0]] == [2, 3] and len(before[1]) == 5

    # A replayed batch sees the state before it and writes the same again.
    assert cluster_batch(store, 1, NOW + 9999, params) == second
    assert state(store) == before
    assert cluster_batch(store, 2, NOW + 20, params)["found_new"] == 0


def test_refresh_from_additions_equals_refresh_from_all_members(spark):
    rows = [article(f"x{i}", f"T{i}", text(f"{FLOOD} {i} " * (i + 1)), summary="short note" if i % 2 else None) for i in range(6)]
    df = articles(spark, rows).drop("cluster_id").withColumn("cluster_id", F.lit("k"))
    old, new = df.filter("article_id < 'x3'"), df.filter("article_id >= 'x3'")
    for mode in ("title_only", "full"):
        params = Params(embed_dim=32, update_text=mode)
        grown = C.extend_clusters(C.build_clusters(old, NOW, params), new, NOW + 1, params).collect()
        whole = C.build_clusters(df, NOW + 1, params, stage="refresh").collect()
        assert grown == whole


def test_member_without_summary_counts_with_its_title_only_after_a_refresh(spark):
    df = articles(spark, [article("x", "Flood", text(FLOOD))]).drop("cluster_id").withColumn("cluster_id", F.lit("k"))
    created = C.build_clusters(df, NOW, DIM).first()
    refreshed = C.build_clusters(df, NOW, DIM, stage="refresh").first()
    assert sum(map(abs, created.text_counts)) == 1 == sum(map(abs, refreshed.text_counts))
    assert sum(1 for v in created.cluster_embedding if v) > 5 and sum(1 for v in refreshed.cluster_embedding if v) == 1


def test_missing_members_are_skipped_and_members_added_once(spark):
    members = spark.createDataFrame(
        [("k", "s", "a", 1), ("k", "s", "a", 5), ("k", "s", "gone", 1)], "cluster_id string, source string, article_id string, added_at bigint"
    )
    got = C.member_articles(members, articles(spark, [article("a")])).collect()
    assert [(r.article_id, r.added_at, r.article_summary) for r in got] == [("a", 1, "")]
    again = spark.createDataFrame([("k", "s", "a", 9), ("k", "s", "b", 9)], members.schema)
    assert [r.article_id for r in C.member_additions(again, members).collect()] == ["b"]


def test_cluster_text_parts_join_to_the_whole(spark):
    rows = [("k", f"{i:08x}" + "0" * 56, "p" * 10 + str(i)) for i in range(0, 2**32, 2**28)]
    df = spark.createDataFrame(rows, "cluster_id string, article_id string, passage string")
    whole = C.cluster_text(df).first().text
    parts = C.cluster_text(df, Params(text_part_chars=50)).orderBy("part").collect()
    assert len(parts) > 3 and "\n\n".join(r.text for r in parts) == whole


def test_empty_run(spark):
    run = cluster_run(articles(spark, []), spark.createDataFrame([], CLUSTERS), NOW, DIM)
    assert run.decisions.isEmpty() and run.changed.isEmpty() and run.members.isEmpty()


def pages(spark, rows=PAGES):
    """Pages of (id, url, html), or with the time of their fetch."""
    return spark.createDataFrame([(*r, None)[:4] for r in rows], PAGES_SCHEMA)


def test_ingest_batches_fill_tables_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    ingest_batch(store, pages(spark), 0, NOW, DIM)
    ingest_batch(store, pages(spark), 0, NOW + 5, DIM)
    ingest_batch(store, pages(spark), 1, NOW + 60, DIM)
    assert sorted(r.source for r in store.articles().collect()) == ["lapsi", "pamfleti", "syri"]
    assert store.ledger().count() == 3
    assert {(r.source, r.metric): r.value for r in store.stats().collect()} == {
        (s, m): 1
        for s, c in (("lapsi", "te-fundit"), ("pamfleti", "aktualitet"), ("syri", "politike"))
        for m in ("total_articles", f"category_{c}")
    }
    # The next day the same URLs are read again.
    ingest_batch(store, pages(spark), 2, NOW + DAY_S, DIM)
    assert store.articles().count() == 6


LISTING = """<div id="content">{}</div>"""
CARD = """<article><div class="post-content-wrapper"><a href="{}">T {}</a></div></article>"""
PAGE = """<div class="entry-meta"><time class="published" datetime="2024-10-21T14:30:00+02:00">x</time></div><div class="entry-content"><p>{}</p></div>"""
LAPSI = "https://lapsi.al/kategoria/te-fundit/"


def listing(*links):
    return LISTING.format("".join(CARD.format(link, i) for i, link in enumerate(links)))


def test_a_page_may_come_in_a_later_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    links = [f"https://lapsi.al/p{i}" for i in range(7)]
    ingest_batch(store, pages(spark, [(1, LAPSI, listing(*links))]), 0, NOW, DIM)
    assert store.articles().count() == 0
    # What waits takes no place in the quota of the next crawl: the last two get theirs.
    ingest_batch(store, pages(spark, [(2, LAPSI, listing(*links)), (3, links[0], PAGE.format("zero"))]), 1, NOW + 10, DIM)
    assert [r.article_url for r in store.articles().collect()] == links[:1]
    ingest_batch(store, pages(spark, [(4 + i, u, PAGE.format(u)) for i, u in enumerate(links)]), 2, NOW + 20, DIM)
    ingest_batch(store, pages(spark, [(4 + i, u, PAGE.format(u)) for i, u in enumerate(links)]), 2, NOW + 30, DIM)
    assert sorted(r.article_url for r in store.articles().collect()) == links
    assert store.requests(before=3, since=0).count() == 0
    # What does not come within `request_days` is given up.
    ingest_batch(store, pages(spark, [(1, LAPSI, listing("https://lapsi.al/never"))]), 3, NOW + 40, DIM)
    assert store.requests(before=4, since=0).count() == 1
    ingest_batch(store, pages(spark, []), 4, NOW + 9 * DAY_S, DIM)
    assert store.requests(before=5, since=0).count() == 0


def test_a_page_crawled_twice_is_one_article_of_its_newest_copy(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    url = "https://lapsi.al/a"
    rows = [(1, LAPSI, listing(url), 5), (2, url, PAGE.format("new " + FLOOD), 9), (3, url, PAGE.format("old"), 7), (4, url, PAGE.format("old"), None)]
    ingest_batch(store, pages(spark, rows), 0, NOW, DIM)
    (only,) = store.articles().collect()
    assert only.article_content[0].content == "new " + FLOOD
    assert cluster_batch(store, 0, NOW, DIM)["new_clusters"] == 0


def test_each_crawl_of_a_listing_has_its_own_quota(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first, second = [f"https://lapsi.al/f{i}" for i in range(6)], [f"https://lapsi.al/s{i}" for i in range(6)]
    rows = [(1, LAPSI, listing(*first), 1), (2, LAPSI, listing(*second), 2)]
    ingest_batch(store, pages(spark, rows + [(3 + i, u, PAGE.format(u), 3) for i, u in enumerate(first + second)]), 0, NOW, DIM)
    assert sorted(r.article_url for r in store.articles().collect()) == first[:5] + second[:5]


def test_one_url_in_two_categories_is_two_articles_with_keys_of_their_own(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = articles(spark, [article("a", "Flood", text(FLOOD), NOW - 10), article("b", "Flood", text(FLOOD), NOW - 10)])
    same = df.drop("article_url", "article_category").withColumn("article_url", F.lit("u")).withColumn("article_category", F.col("article_id"))
    stored = stored_form(same, NOW)
    assert stored.select("article_id").distinct().count() == 2
    save(store, stored, 0)
    assert cluster_batch(store, 0, NOW, DIM)["new_clusters"] == 1
    assert store.members().count() == 2 and store.clusters().first().n_members == 2


def test_repeated_keys_count_once_in_a_cluster_run(spark):
    rows = [article("a", "Flood", text(FLOOD), NOW), article("b", "Flood", text(FLOOD), NOW), article("c", "Vote", text(VOTE), NOW)]
    once = cluster_run(articles(spark, rows), spark.createDataFrame([], CLUSTERS), NOW, DIM)
    twice = cluster_run(articles(spark, rows + rows[:2]), spark.createDataFrame([], CLUSTERS), NOW, DIM)
    for name in ("decisions", "changed", "members", "metrics"):
        assert sorted(map(str, getattr(twice, name).collect())) == sorted(map(str, getattr(once, name).collect()))
    again = cluster_run(articles(spark, rows), spark.createDataFrame([], CLUSTERS), NOW, DIM, recent_members=once.members)
    assert again.members.count() == 0


def test_streams_ingest_and_cluster(spark, tmp_path):
    source, store = str(tmp_path / "pages"), Store(spark, str(tmp_path / "store"))
    pages(spark).coalesce(1).write.parquet(source)
    assert read_pages(spark, source).count() == len(PAGES)
    ingest_stream(stream_pages(spark, source), store, str(tmp_path / "c1"), DIM, clock=lambda: NOW, once=True).awaitTermination()
    assert store.articles().count() == 3
    ticks = stream_pages(spark, source)
    cluster_stream(ticks, store, str(tmp_path / "c2"), DIM, clock=lambda: NOW, once=True).awaitTermination()
    assert store.last_finished("cluster") == 0
    # Dated weeks before the run, the three articles are outside its lookback.
    cluster_stream(ticks, store, str(tmp_path / "c3"), Params(embed_dim=64, article_lookback_s=10**8), clock=lambda: NOW, once=True).awaitTermination()
    assert store.members().count() == store.articles().filter("cluster_id is not null").count()


def feed_files(spark, tmp_path, sf="sf0.001"):
    events = spark.read.parquet(f"/root/testdata/{sf}/events.parquet")
    feed = events.select(
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source"),
        F.col("event_type").alias("category"),
        F.col("props").alias("url"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    path = str(tmp_path / "feed")
    for i, (a, b) in enumerate([("01", "08"), ("08", "16"), ("16", "24"), ("24", "32")]):
        day = F.date_format("ts", "dd")
        feed.filter((day >= a) & (day < b)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1 if i < 3 else 0)
    return feed, spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streaming_dedup_and_counters_equal_batch(spark, tmp_path):
    feed, stream = feed_files(spark, tmp_path)
    store = Store(spark, str(tmp_path / "store"))
    timed = stream.withColumn("ts_s", F.unix_timestamp("ts"))
    ledger_stream(timed, store, str(tmp_path / "c3"), once=True).awaitTermination()
    batch = feed.select("source", "category", "url", F.to_date("ts")).distinct()
    assert store.ledger().count() == store.ledger().distinct().count() == batch.count()
    # Run again from the start, every batch finds what it wrote.
    ledger_stream(timed, store, str(tmp_path / "c3b"), once=True).awaitTermination()
    assert store.ledger().count() == batch.count()

    query = running_stats(stream).writeStream.outputMode("update").format("memory").queryName("counts")
    query.option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start().awaitTermination()
    last = spark.table("counts").groupBy("source", "metric").agg(F.max("value").alias("value"))
    assert sorted(last.collect()) == sorted(running_stats(feed).collect())


def test_stored_form_is_replay_safe(spark):
    df = articles(spark, [article("a"), article("b")])
    one, two = stored_form(df, NOW), stored_form(df, NOW + 100)
    assert sorted(r.article_id for r in one.collect()) == sorted(r.article_id for r in two.collect())


def test_reads_are_pruned_by_partition(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    ingest_batch(store, pages(spark), 0, NOW, DIM)
    plan = store.ledger().filter(f"day = {NOW - NOW % DAY_S}")._jdf.queryExecution().executedPlan().toString()
    assert "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # Where a time is given, the folders of its days are all that is opened.
    assert all(f"/day={NOW - NOW % DAY_S}/" in f for f in store.pending_articles(0, 0, NOW).inputFiles())
    assert store.articles().inputFiles() and not store.pending_articles(0, 0, NOW + DAY_S).inputFiles()


def test_reads_of_recent_days_open_no_older_folder(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    days = [NOW - k * DAY_S for k in range(4)]
    rows = [("s", "c", f"u{k}", d - d % DAY_S) for k, d in enumerate(days)]
    store.add_ledger(spark.createDataFrame(rows, "source string, category string, url string, day bigint"), 0)
    recent = store.ledger(since=days[1])
    assert sorted(r.url for r in recent.collect()) == ["u0", "u1"]
    assert len(recent.inputFiles()) == 2
    assert store.ledger(since=NOW + DAY_S).isEmpty() and store.ledger().count() == 4


def test_last_finished_batch_is_the_largest_that_was_written_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.last_finished("ingest") == -1
    for batch in (9, 10, 999, 1000, 1002):
        store.close_run("ingest", batch)
    (tmp_path / "runs/kind=ingest_done/block=1/batch=1002/_SUCCESS").unlink()
    assert store.last_finished("ingest") == 1000


def cluster_row(name, batch, at):
    return (name, f"{name} {batch}", None, [1.0], at, batch, 1, "a", [], [1])


def test_folded_days_read_the_same(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    old, new = NOW - 3 * DAY_S, NOW
    for batch, (at, names) in enumerate([(old, "ab"), (old + 1, "bc"), (old + 2, "c"), (new, "ad")]):
        store.add_clusters(spark.createDataFrame([cluster_row(n, batch, at) for n in names], CLUSTERS), batch)
        store.add_ledger(spark.createDataFrame([("s", "c", f"u{batch}", at - at % DAY_S)], "source string, category string, url string, day bigint"), batch)

    def seen():
        reads = [sorted((r.cluster_id, r.cluster_title) for r in store.clusters(before, since).collect()) for before in (3, 4, None) for since in (None, old, new)]
        return reads, [sorted(r.url for r in store.ledger(before, since).collect()) for before in (None, 3) for since in (None, old, new)]

    first = seen()
    # The last batch of the old day is not known to be done yet.
    assert store.fold("clusters", NOW, 1) == [old - old % DAY_S] and store.fold("ledger", NOW, 1)
    assert seen() == first
    assert store.fold("clusters", NOW, 3) == store.fold("ledger", NOW, 3) == [old - old % DAY_S]
    assert seen() == first and store.fold("clusters", NOW, 3) == []
    assert store.drop_folded("clusters") == 4 and store.drop_folded("ledger") == 4 and store.drop_folded("clusters") == 0
    assert seen() == first
    # One folder is left of the day, however many batches there were; a late batch of it counts all the same.
    assert len(list((tmp_path / "folded/clusters").glob("day=*/upto=*"))) == 1 and not list((tmp_path / f"clusters/day={old - old % DAY_S}").glob("batch=*"))
    store.add_clusters(spark.createDataFrame([cluster_row("b", 4, old + 9)], CLUSTERS), 4)
    assert {r.cluster_id: r.cluster_title for r in store.clusters().collect()}["b"] == "b 4"
    assert store.fold("clusters", NOW, 4) == [old - old % DAY_S]
    assert {r.cluster_id: r.cluster_title for r in store.clusters().collect()}["b"] == "b 4"


def letter_model():
    """A model of its own: counts of a few letters, so the dimension differs from the built-in one."""

    def letters(texts):
        return texts.map(lambda t: [float(t.lower().count(c)) + 0.01 for c in "abdeg"])

    return letters


letters = letter_model()


def test_own_models_make_cluster_vectors_and_summaries_from_all_members(spark, tmp_path):
    import json

    def tell(cluster_texts):
        return [json.dumps({"cluster_title": f"{t.count('Title: ')} articles", "cluster_content": t[:20]}) for t in cluster_texts]

    models = Models(embed=letters, summarize_cluster=tell)
    store = Store(spark, str(tmp_path))
    twin = "water rose over the bridge"
    save(store, articles(spark, [article("a1", "Flood", text(twin)), article("a2", "Flood", text(twin), summary="rain again")]), 0)
    params = Params(eps=0.9, assign_threshold=0.1)
    assert cluster_batch(store, 0, NOW, params, models)["new_clusters"] == 1
    first = store.clusters().first()
    assert first.cluster_title == "2 articles"
    joined = f"Flood {twin}\n\nFlood rain again"
    assert first.cluster_embedding == pytest.approx(letters(pd.Series([joined]))[0])

    save(store, articles(spark, [article("b1", "Bridge", text(twin))]), 1)
    assert cluster_batch(store, 1, NOW + 10, params, models)["assigned"] == 1
    second = store.clusters().first()
    assert second.cluster_title == "3 articles" and second.n_members == 3
    joined = "Flood\n\nFlood rain again\n\nBridge"
    assert second.cluster_embedding == pytest.approx(letters(pd.Series([joined]))[0])


def numbered(spark, n, words):
    """Members of one cluster, in an order of addition that is not that of their ids."""
    rows = [article(f"{(i * 37) % 64:02x}", f"T{i}", text(" ".join(f"w{i}.{k}" for k in range(words)))) for i in range(n)]
    df = articles(spark, rows).drop("cluster_id").withColumn("cluster_id", F.lit("k"))
    return df.withColumn("added_at", F.expr("cast(substr(article_title, 2) as bigint)"))


def test_windows_are_those_of_the_whole_text(spark):
    df = numbered(spark, 30, 7)
    passages = df.select("cluster_id", "added_at", "article_id", F.concat(F.lit(" T  "), F.col("article_content")[0]["content"]).alias("passage"))
    passages = passages.unionByName(passages.limit(1).select(F.lit("one").alias("cluster_id"), "added_at", "article_id", F.lit("").alias("passage")))
    whole = "\n\n".join(r.passage for r in passages.filter("cluster_id = 'k'").orderBy("added_at").collect())
    for window in (1000, 13, 2):
        for width in ("1", "4"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            rows = C.text_windows(passages.repartition(5), window).collect()
            mine = sorted((r.window, r.tokens, r.text) for r in rows if r.cluster_id == "k")
            tokens = whole.split()
            assert [t.split() for _, _, t in mine] == [tokens[i : i + window] for i in range(0, len(tokens), window)]
            assert [n for _, n, _ in mine] == [len(t.split()) for _, _, t in mine]
            assert [(r.window, r.text) for r in rows if r.cluster_id == "one"] == [(0, "")]
            assert window < 1000 or mine[0][2] == whole
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_cluster_models_do_not_depend_on_how_texts_are_stored(spark):
    import json

    def tell(cluster_texts):
        # An answer as long as its text: levels shrink all the same.
        return [json.dumps({"cluster_title": t.split()[0], "cluster_content": t}) for t in cluster_texts]

    df = numbered(spark, 40, 11)
    small = articles(spark, [article("0" * 64, "T", text("w"))]).drop("cluster_id").withColumn("cluster_id", F.lit("one")).withColumn("added_at", F.lit(1).cast("bigint"))
    both = df.unionByName(small)
    for window in (50, 13):
        results = []
        for chars in (1000, 4 << 20):
            params = Params(text_part_chars=chars)
            told = sorted(map(tuple, C.summarize_clusters(both, tell, params, window).collect()))
            vectors = sorted((r.cluster_id, tuple(r.cluster_embedding)) for r in C.embed_clusters(both, letters, "full", params, window).collect())
            results.append((told, vectors))
        assert results[0] == results[1]
        assert [t[0] for t in results[0][0]] == ["k", "one"] == [v[0] for v in results[0][1]]
        assert results[0][0][0][1] == "Title:"
