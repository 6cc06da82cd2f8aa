"""Cluster upkeep: members, texts, embeddings, summaries, new and refreshed clusters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storygraph.functions.text import paragraphs, refresh_text, short_text, token_count, truncate_tokens
from storygraph.functions.vectors import let, unit_vector
from storygraph.operators.embed import counts_of, embed_text
from storygraph.operators.models import WINDOW_TOKENS, EmbedFn, Models, SummaryFn
from storygraph.operators.summarize import best_sentences, key_order, parse_summary, sentences_of, summarize_text
from storygraph.params import Params
from storygraph.session import materialize

MEMBER_KEY = ["source", "article_id"]
# Rows whose counts are whole arrays at a time.
KEYS = 1024


def new_cluster_id(first_member: Column, as_of: int) -> Column:
    """Id of a cluster made at ``as_of``: an article enters one cluster only, so its first member names it."""
    return F.sha2(F.concat_ws("#", first_member.cast("string"), F.lit(as_of).cast("string")), 256)


def member_additions(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """Candidate members (cluster_id, source, article_id, added_at) the cluster does not have yet."""
    keys = ["cluster_id", *MEMBER_KEY]
    return candidates.dropDuplicates(keys).join(members.select(keys), keys, "left_anti")


def member_articles(members: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles of the members, each article once per cluster; members without an article drop out."""
    once = members.groupBy("cluster_id", *MEMBER_KEY).agg(F.min("added_at").alias("added_at"))
    wanted = articles.select(
        *MEMBER_KEY,
        "article_title",
        "article_content",
        F.coalesce("article_summary", F.lit("")).alias("article_summary"),
    )
    return once.join(wanted, MEMBER_KEY)


def member_lists(members: DataFrame, per_chunk: int = 10000) -> DataFrame:
    """Member lists per cluster and time of addition, cut into chunks of bounded length."""
    groups = ["cluster_id", "added_at"]
    counts = members.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / per_chunk).cast("bigint").alias("chunks"))
    ref = F.concat_ws("/", *MEMBER_KEY)
    spot = F.conv(F.substring(F.md5(ref), 1, 8), 16, 10).cast("bigint")
    return (
        members.join(counts, groups)
        .withColumn("chunk", F.pmod(spot, F.col("chunks")))
        .groupBy(*groups, "chunk")
        .agg(F.sort_array(F.collect_set(ref)).alias("articles"))
    )


def summary_passage(title: Column, content: Column) -> Column:
    """What one member adds to the text a cluster summary is written from."""
    return F.concat(F.lit("Title: "), title, F.lit("\nContent: "), paragraphs(content))


def embedding_passage(title: Column, summary: Column, content: Column, update_text: str = "full") -> Column:
    """What one member adds to the text a cluster is embedded from."""
    return refresh_text(title, summary) if update_text == "title_only" else short_text(title, summary, content)


def cluster_text(passages: DataFrame, params: Params = Params()) -> DataFrame:
    """(cluster_id, part, text): passages in member order joined by blank lines.

    ``passages`` holds cluster_id, article_id (a uniform hex digest) and passage.
    A cluster whose text exceeds ``text_part_chars`` is cut into parts by ranges
    of the digest, which keeps the order and needs no sort of the whole cluster:
    the full text is the parts in order, joined by blank lines.
    """
    sizes = passages.groupBy("cluster_id").agg(
        F.ceil(F.sum(F.length("passage")) / params.text_part_chars).cast("bigint").alias("parts")
    )
    spot = F.conv(F.substring("article_id", 1, 8), 16, 10).cast("bigint")
    part = F.shiftright(spot * F.greatest("parts", F.lit(1)), 32)
    ordered = F.sort_array(F.collect_list(F.struct("article_id", "passage")))
    return (
        passages.join(sizes, "cluster_id")
        .withColumn("part", part)
        .groupBy("cluster_id", "part")
        .agg(F.array_join(F.transform(ordered, lambda m: m["passage"]), "\n\n").alias("text"))
    )


def sum_counts(rows: DataFrame, keys: list[str], passage: str, dim: int, forms: int = 1) -> DataFrame:
    """(keys, sums): the counts of the passages of a key as an array of ``forms * dim`` sums; a key without any has no row.

    With several forms a column ``form`` tells which stretch of the array a row counts for. What
    travels is the buckets that have a count: rows of a key that meet in a batch are added up before
    the shuffle, in the process that counts them, and the rest by a pass over rows sorted by key,
    which holds one sum between batches.
    """
    given = rows.select(*keys, (F.col("form") if forms > 1 else F.lit(0)).cast("int").alias("_form"), F.col(passage).alias("_passage"))
    width = forms * dim
    key_types = [rows.schema[k] for k in keys]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("_passage")))
            if not batch.num_rows:
                continue
            first, row = np.unique(_codes(batch, keys), return_index=True, return_inverse=True)[1:]
            # A stretch of keys at a time bounds what is held as whole arrays.
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(0, len(first) + KEYS, KEYS))
            for k, (begin, end) in enumerate(pairwise(ends.tolist())):
                some = order[begin:end]
                names = batch.select(keys).take(pa.array(first[k * KEYS : (k + 1) * KEYS]))
                sums, told = np.zeros((names.num_rows, width), np.int64), np.zeros((names.num_rows, width), bool)
                of = batch.select(["_form", "_passage"]).take(pa.array(some))
                form, texts = of.column("_form").to_pylist(), of.column("_passage").to_pylist()
                for at, f, found in zip((row[some] - k * KEYS).tolist(), form, counts_of(texts, dim), strict=True):
                    sums[at, f * dim : (f + 1) * dim] += found
                    told[at, f * dim : (f + 1) * dim] |= found != 0
                at, pos = np.nonzero(told)
                each = told.sum(axis=1)
                listed = [pa.ListArray.from_arrays(np.r_[0, np.cumsum(each)].astype(np.int32), pa.array(v)) for v in (pos.astype(np.int32), sums[at, pos])]
                yield pa.RecordBatch.from_arrays([*names.columns, *listed], [*keys, "_pos", "_n"]).filter(pa.array(each > 0))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            for s in range(0, whole.num_rows, KEYS):
                batch = whole.slice(s, KEYS)
                codes = _codes(batch, keys)
                new = np.r_[True, codes[1:] != codes[:-1]]
                names = batch.select(keys).take(pa.array(np.flatnonzero(new)))
                sums = _added(batch, np.cumsum(new) - 1, names.num_rows, width)
                if held is not None:
                    if names.slice(0, 1).equals(held[0]):
                        sums[0] += held[1][0]
                    else:
                        yield listed(*held)
                held = names.slice(names.num_rows - 1), sums[-1:]
                if names.num_rows > 1:
                    yield listed(names.slice(0, names.num_rows - 1), sums[:-1])
        if held is not None:
            yield listed(*held)

    def listed(names: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
        ends = np.arange(0, sums.size + 1, width, dtype=np.int32)
        return pa.RecordBatch.from_arrays([*names.columns, pa.ListArray.from_arrays(ends, pa.array(sums.reshape(-1)))], [*keys, "sums"])

    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    met = given.mapInArrow(counted, T.StructType([*key_types, T.StructField("_pos", ints), T.StructField("_n", longs)]))
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(total, T.StructType([*key_types, T.StructField("sums", longs)]))


def _codes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """A number for each row, the same for equal keys."""
    codes = np.zeros(batch.num_rows, np.int64)
    for key in keys:
        named = batch.column(key).dictionary_encode()
        codes = codes * (len(named.dictionary) + 1) + named.indices.fill_null(len(named.dictionary)).to_numpy()
    return codes


def _added(batch: pa.RecordBatch, row: np.ndarray, rows: int, width: int) -> np.ndarray:
    """The counts of a batch added up to ``rows`` arrays, each row to the one at ``row``."""
    at = np.repeat(row, pc.list_value_length(batch.column("_pos")).to_numpy()) * width + batch.column("_pos").flatten().to_numpy()
    sums = np.zeros(rows * width, np.int64)
    np.add.at(sums, at, batch.column("_n").flatten().to_numpy())
    return sums.reshape(rows, width)


def add_counts(a: Column, b: Column) -> Column:
    """Sum of two count arrays either of which may be NULL."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))


def cluster_features(members: DataFrame, dim: int, passage: Column) -> DataFrame:
    """(cluster_id, counts) of the joined member passages."""
    passages = members.select("cluster_id", passage.alias("passage"))
    return sum_counts(passages, ["cluster_id"], "passage", dim).withColumnRenamed("sums", "counts")


def cluster_embedding(members: DataFrame, params: Params = Params(), update_text: str = "full") -> DataFrame:
    """(cluster_id, cluster_embedding) of the joined member texts, not a mean of member vectors."""
    passage = embedding_passage(F.col("article_title"), F.col("article_summary"), F.col("article_content"), update_text)
    return cluster_features(members, params.embed_dim, passage).select(
        "cluster_id", unit_vector(F.col("counts")).alias("cluster_embedding")
    )


def key_sentences(members: DataFrame, n: int) -> DataFrame:
    """(cluster_id, key_sentences): the ``n`` different sentences of all members that tell most, the best first.

    Members give their own best ones, equal ones fall together, and each task keeps ``n`` rows of a
    cluster before the shuffle: no more than that of a cluster meets in one place.
    """
    own = best_sentences(sentences_of(paragraphs(F.col("article_content"))), n)
    once = members.select("cluster_id", F.explode(own).alias("sentence")).distinct()
    order = Window.partitionBy("cluster_id").orderBy("key")
    top = once.withColumn("key", key_order(F.col("sentence"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    listed = F.sort_array(F.collect_list("key"))
    return top.groupBy("cluster_id").agg(F.transform(listed, lambda k: k["sentence"]).alias("key_sentences"))


def sentences_text(sentences: Column) -> Column:
    return F.nullif(F.array_join(sentences, " "), F.lit(""))


def lead_member(members: DataFrame) -> DataFrame:
    """(cluster_id, n_members, lead_words, lead_id, cluster_title).

    The member with most words leads (the smallest id of equals) and gives the title.
    """
    words = token_count(paragraphs(F.col("article_content"))).cast("bigint")
    ranked = members.select("cluster_id", "article_id", words.alias("words"), "article_title")
    best = F.min(F.struct((-F.col("words")).alias("minus"), "article_id", "article_title")).alias("lead")
    return (
        ranked.groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("n_members"), best)
        .select(
            "cluster_id",
            "n_members",
            (-F.col("lead.minus")).alias("lead_words"),
            F.col("lead.article_id").alias("lead_id"),
            F.col("lead.article_title").alias("cluster_title"),
        )
    )


def cluster_summary(members: DataFrame, params: Params = Params()) -> DataFrame:
    """The built-in cluster summary, from all members: ``lead_member`` with key_sentences and cluster_content."""
    told = lead_member(members).join(key_sentences(members, params.summary_sentences), "cluster_id", "left")
    told = told.withColumn("key_sentences", F.coalesce("key_sentences", F.array().cast("array<string>")))
    return told.withColumn("cluster_content", sentences_text(F.col("key_sentences")))


def build_clusters(members: DataFrame, as_of: int, params: Params = Params(), stage: str = "create") -> DataFrame:
    """Cluster rows from all of their member articles.

    ``members`` holds cluster_id, source, article_id, article_title,
    article_summary, article_content. ``stage`` "create" embeds title with summary
    or paragraphs; "refresh" uses ``params.update_text``. ``text_counts`` always
    carries the refresh form, ready for the next addition.
    """
    title, summary, content = F.col("article_title"), F.col("article_summary"), F.col("article_content")
    kept_form = params.update_text
    kept = embedding_passage(title, summary, content, kept_form)
    differs = stage == "create" and kept_form != "full"
    forms = [kept, embedding_passage(title, summary, content)] if differs else [kept]
    each = F.posexplode(F.array(*forms)).alias("form", "passage")
    sums = sum_counts(members.select("cluster_id", each), ["cluster_id"], "passage", params.embed_dim, len(forms))
    vectors = sums.select(
        "cluster_id",
        F.slice("sums", 1, params.embed_dim).alias("text_counts"),
        F.slice("sums", params.embed_dim * (len(forms) - 1) + 1, params.embed_dim).alias("_embed"),
    )
    return (
        cluster_summary(members, params)
        .join(vectors, "cluster_id", "left")
        .select(
            "cluster_id",
            "cluster_title",
            "cluster_content",
            unit_vector(F.col("_embed")).alias("cluster_embedding"),
            F.lit(as_of).cast("bigint").alias("last_updated"),
            "n_members",
            "lead_words",
            "lead_id",
            "key_sentences",
            "text_counts",
        )
    )


def extend_clusters(clusters: DataFrame, additions: DataFrame, as_of: int, params: Params = Params()) -> DataFrame:
    """New rows of the clusters that gain members, from their old rows and the added articles alone.

    Equal to ``build_clusters(all members, stage="refresh")`` without reading the
    old members again.
    """
    delta = build_clusters(additions, as_of, params, stage="refresh")
    d = {c: F.col(f"d.{c}") for c in delta.columns}
    o = {c: F.col(f"o.{c}") for c in delta.columns}
    new_leads = (d["lead_words"] > o["lead_words"]) | (
        (d["lead_words"] == o["lead_words"]) & (d["lead_id"] < o["lead_id"])
    )

    def led(name: str) -> Column:
        return F.when(new_leads, d[name]).otherwise(o[name]).alias(name)

    summed = add_counts(o["text_counts"], d["text_counts"])
    told = best_sentences(F.concat(o["key_sentences"], d["key_sentences"]), params.summary_sentences)
    return (
        delta.alias("d")
        .join(clusters.alias("o"), F.col("d.cluster_id") == F.col("o.cluster_id"))
        .select(
            d["cluster_id"],
            led("cluster_title"),
            sentences_text(told).alias("cluster_content"),
            unit_vector(summed).alias("cluster_embedding"),
            F.lit(as_of).cast("bigint").alias("last_updated"),
            (o["n_members"] + d["n_members"]).alias("n_members"),
            led("lead_words"),
            led("lead_id"),
            told.alias("key_sentences"),
            summed.alias("text_counts"),
        )
    )


def text_windows(passages: DataFrame, window: int) -> DataFrame:
    """(cluster_id, window, tokens, text): cluster texts in windows of ``window`` blank-separated tokens.

    ``passages`` holds cluster_id, added_at, article_id and passage. The text of a cluster is its
    passages in the order of addition, then id, joined by blank lines; every token has its place
    in it, and a passage that reaches over the end of a window is cut there. Rows are dealt by
    ranges of that order: the places come from sums per cluster and range, so a cluster that
    holds most rows is many ranges, and where they are cut does not show in the result.
    """
    order = ["added_at", "article_id"]
    rows = passages.select("cluster_id", *order, F.coalesce("passage", F.lit("")).alias("passage"))
    rows = rows.withColumn("n", token_count(F.col("passage")).cast("bigint"))
    dealt, _ = materialize(rows.repartitionByRange("cluster_id", *order).withColumn("_range", F.spark_partition_id()))
    # As many rows as there are ranges that hold some of a cluster.
    sums = dealt.groupBy("cluster_id", "_range").agg(F.sum("n").alias("sum"))
    earlier = Window.partitionBy("cluster_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("cluster_id", "_range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"), F.sum("sum").over(Window.partitionBy("cluster_id")).alias("total"))
    inside = Window.partitionBy("cluster_id", "_range").orderBy(*order, "passage").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, ["cluster_id", "_range"])
    placed = placed.withColumn("start", F.col("before") + F.col("inside"))
    size = F.lit(window).cast("bigint")
    last = F.greatest(F.floor((F.col("total") - 1) / size), F.lit(0))
    first, final = F.least(F.floor(F.col("start") / size), last), F.least(F.floor((F.col("start") + F.greatest("n", F.lit(1)) - 1) / size), last)
    each = placed.select("cluster_id", *order, "passage", "n", "start", F.explode(F.sequence(first, final)).alias("window"))
    begin = F.greatest(F.col("window") * size - F.col("start"), F.lit(0))
    end = F.least((F.col("window") + 1) * size - F.col("start"), F.col("n"))
    tokens = F.regexp_extract_all("passage", F.lit(r"(?:^\s+)?\S+\s*"), F.lit(0))
    cut = F.array_join(F.slice(tokens, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int")), "")
    whole = (begin == 0) & (end == F.col("n"))
    pieces = each.select("cluster_id", "window", *order, F.greatest(end - begin, F.lit(0)).alias("n"), F.when(whole, F.col("passage")).otherwise(cut).alias("piece"))
    ordered = F.sort_array(F.collect_list(F.struct(*order, "piece")))
    return pieces.groupBy("cluster_id", "window").agg(
        F.sum("n").alias("tokens"), F.array_join(F.transform(ordered, lambda m: m["piece"]), "\n\n").alias("text")
    )


def _passages(members: DataFrame, passage: Column) -> DataFrame:
    """Members without a time of addition count as added together."""
    added = F.col("added_at") if "added_at" in members.columns else F.lit(0).cast("bigint")
    return members.select("cluster_id", added.alias("added_at"), "article_id", passage.alias("passage"))


def embed_clusters(members: DataFrame, fn: EmbedFn, update_text: str, params: Params = Params(), window: int = WINDOW_TOKENS) -> DataFrame:
    """(cluster_id, cluster_embedding): the model's vector of the joined member texts.

    A text of more tokens than the model's window gets the mean of its windows' vectors, weighted by tokens.
    """
    passage = embedding_passage(F.col("article_title"), F.col("article_summary"), F.col("article_content"), update_text)
    texts = text_windows(_passages(members, passage), window)
    parts = texts.select("cluster_id", F.greatest("tokens", F.lit(1)).alias("size"), embed_text(F.col("text"), fn, params).alias("vector"))
    summed = (
        parts.select("cluster_id", "size", F.posexplode_outer("vector").alias("pos", "x"))
        .filter("pos is not null")
        .groupBy("cluster_id", "pos")
        .agg((F.sum(F.col("x").cast("double") * F.col("size")) / F.sum("size")).alias("x"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.col("x").cast("float").alias("x"))))
    return summed.groupBy("cluster_id").agg(F.transform(ordered, lambda e: e["x"]).alias("cluster_embedding"))


def summarize_clusters(members: DataFrame, fn: SummaryFn, params: Params = Params(), window: int = WINDOW_TOKENS) -> DataFrame:
    """(cluster_id, cluster_title, cluster_content) by the model from the joined member texts.

    Where a text has several windows, the answers to them, in their order and each up to half
    a window, become the text of the next level. So there are at most half as many windows
    on every level, until one is left.
    """
    if window < 2:
        raise ValueError("a window holds two tokens at least")
    passages = _passages(members, summary_passage(F.col("article_title"), F.col("article_content")))
    done = None
    while True:
        texts = text_windows(passages, window)
        answers, seen = materialize(
            texts.select("cluster_id", "window", parse_summary(summarize_text(F.col("text"), fn)).alias("answer")).select("cluster_id", "window", "answer.*"),
            later=F.max("window"),
        )
        sizes = answers.groupBy("cluster_id").agg(F.max("window").alias("later"))
        level = answers.join(sizes, "cluster_id")
        single = level.filter("later = 0").select("cluster_id", "cluster_title", "cluster_content")
        done = single if done is None else done.unionByName(single)
        if not seen["later"]:
            return done
        text = truncate_tokens(F.concat_ws("\n", "cluster_title", "cluster_content"), window // 2)
        passages = level.filter("later > 0").select("cluster_id", F.col("window").alias("added_at"), F.lit("").alias("article_id"), text.alias("passage"))


def apply_models(changed: DataFrame, members: DataFrame, models: Models, update_text: str, params: Params = Params()) -> DataFrame:
    """Cluster rows with vector and summary by the given models, from all members' articles.

    Where a model gives nothing, the built-in summary stays.
    """
    out = changed
    if models.embed is not None:
        vectors = embed_clusters(members, models.embed, update_text, params, models.window_tokens)
        out = out.drop("cluster_embedding").join(vectors, "cluster_id", "left")
    if models.summarize_cluster is not None:
        names = ("cluster_title", "cluster_content")
        told = summarize_clusters(members, models.summarize_cluster, params, models.window_tokens)
        told = told.select("cluster_id", *[F.col(n).alias(f"_{n}") for n in names])
        out = out.join(told, "cluster_id", "left")
        for n in names:
            out = out.withColumn(n, F.coalesce(f"_{n}", n))
    return out.select(changed.columns)


def upsert_clusters(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored clusters with the changed ones replaced or added."""
    return stored.join(changed.select("cluster_id"), "cluster_id", "left_anti").unionByName(changed)


def with_cluster(articles: DataFrame, assigned: DataFrame) -> DataFrame:
    """Articles with ``cluster_id`` set where ``assigned`` (source, article_id, cluster_id) names one."""
    new = assigned.select(*MEMBER_KEY, F.col("cluster_id").alias("_new"))
    return (
        articles.join(new, MEMBER_KEY, "left")
        .withColumn("cluster_id", F.coalesce("_new", "cluster_id"))
        .drop("_new")
        .select(articles.columns)
    )
