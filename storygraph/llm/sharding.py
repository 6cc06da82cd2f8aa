"""Rendezvous hashing of record keys over weighted shards, and gapless slots within shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storygraph.llm.columns import digest_number, fresh, hash_unit

BUCKET_DIGITS = 3  # hex digits: 4,096 buckets per shard


def rendezvous_shard(key: Sequence[Column], weights: Sequence[float], seed: str = "shard") -> Column:
    """The shard with the highest score of all, as an integer; ties go to the smallest number.

    A shard's score is -weight / ln(u) with u a hash of key and shard in (0, 1), so a shard
    gets keys in proportion to its weight, and a shard added at the end (or a weight raised)
    takes keys only into itself. Null key parts count as empty. A weight of 0 gets nothing.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative and one of them positive")
    scores = [
        F.struct((F.lit(float(w)) / -F.log(hash_unit(F.lit(seed), F.lit(s), *key))).alias("score"), F.lit(-s).alias("s"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    return -F.array_max(F.array(*scores))["s"]


def assign_shards(
    docs: DataFrame, weights: Sequence[float], key: Sequence[str] = ("doc_id",), shard_col: str = "shard", seed: str = "shard"
) -> DataFrame:
    """``docs`` with a shard number from the key columns alone; no shuffle.

    Equal keys share a shard, so repeated rows do too; an existing column of the name is
    replaced. An empty table gives an empty result.
    """
    return docs.withColumn(shard_col, rendezvous_shard([docs[k] for k in key], weights, seed))


def number_slots(rows: DataFrame, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``rows`` with a number from 0 without gaps within each shard.

    Equal rows are counted before anything is sorted and unfolded at the end, so neither a
    hot shard nor a row repeated any number of times is one task's work: a shard is cut into
    4,096 hash buckets, only the sizes of these are summed up per shard, and rows are sorted
    within a bucket. Keep ``rows`` narrow; all columns are part of the order.
    """
    columns = rows.columns
    order = [c for c in columns if c != shard_col]
    copies, bucket_col, start, n = (fresh(c, columns) for c in ("_copies", "_bucket", "_start", "_n"))
    bucket = digest_number(*[F.col(c) for c in order], digits=BUCKET_DIGITS).cast("int")
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias(copies)).withColumn(bucket_col, bucket)
    earlier = Window.partitionBy(shard_col).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counted.groupBy(shard_col, bucket_col)
        .agg(F.sum(copies).alias(n))
        .select(shard_col, bucket_col, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(start))
    )
    inside = Window.partitionBy(shard_col, bucket_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(starts, [shard_col, bucket_col]).withColumn(start, F.col(start) + F.coalesce(F.sum(copies).over(inside), F.lit(0)))
    slot = F.explode(F.sequence(F.col(start), F.col(start) + F.col(copies) - 1))
    return placed.select(*columns, slot.alias(slot_col))
