"""Nearest-cluster join: the most similar cluster of each article."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storygraph.functions.vectors import usable
from storygraph.operators.block_join import block_of, with_blocks
from storygraph.operators.metric_index import SLACK, MetricIndex, build_metric_index
from storygraph.operators.vector_blocks import Vectors, best_match, to_matrix
from storygraph.params import Params
from storygraph.session import materialize

# Parts of the articles that meet blocks of clusters at a time.
WAVE = 8


def nearest_join(
    articles: DataFrame,
    clusters: DataFrame,
    key: str,
    vec_col: str,
    params: Params = Params(),
    mode: str | None = None,
) -> DataFrame:
    """(key, best_id, similarity) for every article that has a direction, NULLs where there is no cluster.

    ``clusters`` holds cluster_id, cluster_embedding, last_updated. Of equally
    similar clusters the one updated least recently wins, then the smallest id.
    Cluster vectors within ``params.broadcast_bytes`` are broadcast and the
    articles stream past them without a shuffle; more than that are put into
    neighbourhoods of pivots, met in the order of what they can hold at best and left out
    once that is less than what an article has found. ``mode`` forces "broadcast" or "blocks".
    """
    base = articles.filter(usable(F.col(vec_col))).select(key, F.col(vec_col).cast("array<float>").alias("vec"))
    state = clusters.filter(usable(F.col("cluster_embedding"))).select(
        "cluster_id", F.col("cluster_embedding").cast("array<float>").alias("vec"), "last_updated"
    )
    size = state.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if size.n == 0:
        return base.select(
            key, F.lit(None).cast(state.schema["cluster_id"].dataType).alias("best_id"), F.lit(None).cast("double").alias("similarity")
        )
    fits = size.n * size.d * 8 <= params.broadcast_bytes
    if mode == "broadcast" or (mode is None and fits):
        return _against_broadcast(base, state, key)
    return _against_blocks(base, state, key, size.n, params)


def assign_to_clusters(
    articles: DataFrame,
    clusters: DataFrame,
    key: str,
    vec_col: str,
    threshold: float,
    params: Params = Params(),
    mode: str | None = None,
) -> DataFrame:
    """(key, cluster_id, similarity): cluster_id is NULL below the threshold."""
    best = nearest_join(articles, clusters, key, vec_col, params, mode)
    near = F.coalesce(F.col("similarity") >= threshold, F.lit(False))
    return best.select(key, F.when(near, F.col("best_id")).alias("cluster_id"), "similarity")


def _order(table: pa.Table) -> np.ndarray:
    """Clusters by last update, then id: the first of equally near ones counts."""
    keys = [("last_updated", "ascending"), ("cluster_id", "ascending")]
    return pc.sort_indices(table.select(["last_updated", "cluster_id"]), sort_keys=keys).to_numpy()


def _against_broadcast(base: DataFrame, state: DataFrame, key: str) -> DataFrame:
    table = state.toArrow()
    order = _order(table)
    ids = table["cluster_id"].take(pa.array(order)).combine_chunks()
    shared = base.sparkSession.sparkContext.broadcast((Vectors.of(table["vec"], order), ids))
    out = T.StructType(
        [base.schema[key], T.StructField("best_id", state.schema["cluster_id"].dataType), T.StructField("similarity", T.DoubleType())]
    )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, ids = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            arg, best = best_match(Vectors.of(batch.column("vec")), vectors)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), ids.take(pa.array(arg)), pa.array(best)], names=[key, "best_id", "similarity"]
            )

    return base.mapInArrow(match, out)


def _against_blocks(base: DataFrame, state: DataFrame, key: str, n_clusters: int, params: Params) -> DataFrame:
    """Every article meets the neighbourhood of clusters that can be nearest, then those that can still beat what it found there.

    Each part of the articles takes a copy of the clusters, so parts go through in waves and what one has dealt out is gone before the next.
    """
    placed, index = build_metric_index(state, "cluster_id", n_clusters, params.block_rows)
    clusters = with_blocks(placed, "cluster_id", index).select("cluster_id", "vec", "last_updated", "_block")
    clusters, _ = materialize(clusters)
    base, seen = materialize(base)
    parts = max(1, math.ceil(seen["rows"] / params.block_rows))
    done = None
    for begin in range(0, parts, WAVE):
        end = min(begin + WAVE, parts)
        some = base.filter(block_of(F.col(key), parts).between(begin, end - 1))
        met = clusters.withColumn("_part", F.explode(F.sequence(F.lit(begin), F.lit(end - 1))))
        first, _ = materialize(_best(_matched(_asked(some, key, index), met, key, parts), key))
        rest = _matched(_asked(some.join(first.select(key, "similarity"), key), key, index), met, key, parts)
        best = _best(first.unionByName(rest), key).select(key, "best_id", "similarity")
        if parts > WAVE:
            best, _ = materialize(best)
        done = best if done is None else done.unionByName(best)
    return done


def _asked(base: DataFrame, key: str, index: MetricIndex) -> DataFrame:
    """(key, vec, _block): the blocks that each article has to meet.

    Without ``similarity`` the bin that may hold the nearest cluster of all; with it, the best
    found there, all other bins that may hold one as near.
    """
    shared = base.sparkSession.sparkContext.broadcast(index)
    again = "similarity" in base.columns

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, cut = shared.value.first_blocks(), shared.value.parts
        for batch in batches:
            if not batch.num_rows:
                continue
            least = shared.value.bin_angles(to_matrix(batch.column("vec")))
            nearest = least.argmin(axis=1)
            if again:
                found = np.arccos(np.clip(batch.column("similarity").to_numpy(), -1.0, 1.0))
                open_bins = least <= found[:, None] + SLACK
                open_bins[np.arange(len(nearest)), nearest] = False
                row, which = np.nonzero(open_bins)
            else:
                row, which = np.arange(len(nearest)), nearest
            block = np.repeat(begin[which], cut[which])
            block = block + np.arange(len(block)) - np.repeat(np.cumsum(cut[which]) - cut[which], cut[which])
            take = pa.array(np.repeat(row, cut[which]))
            for at in range(0, len(take), 4096):
                part = take.slice(at, 4096)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).take(part) for n in names), pa.array(block[at : at + 4096].astype(np.int32))], names=[*names, "_block"]
                )

    names = [key, "vec", "similarity"] if again else [key, "vec"]
    return base.mapInArrow(bins, T.StructType([*(base.schema[n] for n in names), T.StructField("_block", T.IntegerType())]))


def _matched(asked: DataFrame, clusters: DataFrame, key: str, parts: int) -> DataFrame:
    """(key, best_id, similarity, last_updated) of the best cluster in each block that an article meets.

    ``clusters`` are there once for each ``_part`` of the articles. With ``similarity`` only what is as near as that counts.
    """
    again = "similarity" in asked.columns
    key_type = asked.schema[key].dataType.simpleString()
    id_type = clusters.schema["cluster_id"].dataType.simpleString()
    names = [key, "best_id", "similarity", "last_updated"]

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            empty = [left[key], right["cluster_id"], pa.array([], pa.float64()), right["last_updated"]]
            return pa.Table.from_arrays([c.slice(0, 0) for c in empty], names=names)
        order = _order(right)
        arg, best = best_match(Vectors.of(left["vec"]), Vectors.of(right["vec"], order), left["similarity"].to_numpy() if again else None)
        at = np.flatnonzero(arg >= 0)
        take = pa.array(order[arg[at]])
        return pa.Table.from_arrays([left[key].take(pa.array(at)), right["cluster_id"].take(take), pa.array(best[at]), right["last_updated"].take(take)], names=names)

    # Articles are cut by hash, so a block that many of them are near to is met in several tasks.
    left = asked.withColumn("_part", block_of(F.col(key), parts)).groupBy("_part", "_block")
    return left.cogroup(clusters.groupBy("_part", "_block")).applyInArrow(kernel, f"{key} {key_type}, best_id {id_type}, similarity double, last_updated bigint")


def _best(found: DataFrame, key: str) -> DataFrame:
    order = F.struct((-F.col("similarity")).alias("s"), "last_updated", "best_id")
    best = found.groupBy(key).agg(F.min(order).alias("b"))
    return best.select(key, "b.best_id", (-F.col("b.s")).alias("similarity"), "b.last_updated")
