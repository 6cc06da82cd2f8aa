"""Mixing sources to target weights: token totals, repetition rates, repeated documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storygraph.llm.columns import fresh, hash_unit
from storygraph.session import materialize

BROADCAST_SOURCES = 100_000  # rate tables up to so many rows are broadcast
SALTS = 64


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share``
    times all sizes. A target stops at ``limit`` times its source's size and the excess goes
    to the others by weight until none is above, which is a water level: sources are capped
    in the order of limit to weight. A source without size has target and rate 0. The two
    global windows run over one row per source.
    """
    totals = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    weigh = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = totals.withColumn("place", place).withColumn("weight", F.get(weigh, F.col("place") % len(weights)))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    everything = Window.partitionBy(F.lit(0))
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("place")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("pool"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
    )
    level = (F.col("pool") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    ranked = ranked.withColumn("capped", level * F.col("weight") >= F.col("cap"))
    spent = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    left = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything), F.lit(0.0))
    ranked = ranked.withColumn("level", (F.col("pool") - spent) / F.nullif(left, F.lit(0.0)))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    ranked = ranked.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return ranked.select("source", "source_size", "target", rate.alias("rate"))


def with_copies(
    docs: DataFrame,
    size: Column,
    key: Sequence[Column],
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    limit: float = 2.0,
    seed: str = "mix",
    into: str = "mix",
) -> DataFrame:
    """``docs`` with a struct ``into``: size, source_size, target, copies (how often a document is emitted).

    copies is floor(rate) plus one more with the probability of the fraction, drawn from a
    hash of ``seed`` and ``key``: reruns agree, and repeated rows draw alike. Null sources are
    one source, null and empty texts have the size that ``size`` gives them. The rates are
    broadcast only while the table of sources is counted small; otherwise they are joined
    on source and a salt, which splits a source that holds most rows.
    """
    spark = docs.sparkSession
    size_col, salt = fresh("_size", docs.columns), fresh("_salt", docs.columns)
    sized = docs.withColumn(size_col, size)
    rates, seen = materialize(source_targets(sized.select(F.col(source_col).alias("source"), F.col(size_col).alias("size")), weights, share, limit))
    rated = fresh("_rates", docs.columns)
    rates = rates.select(F.struct("source", "source_size", "target", "rate").alias(rated))
    same = F.col(source_col).eqNullSafe(F.col(rated)["source"])
    if seen["rows"] <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(rates), same)
    else:
        salts = spark.range(SALTS).select(F.col("id").cast("int").alias(f"{salt}_other"))
        salted = sized.withColumn(salt, F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int"))
        joined = salted.join(rates.join(F.broadcast(salts)), same & (F.col(salt) == F.col(f"{salt}_other")))
    rate = F.col(rated)["rate"]
    more = (hash_unit(F.lit(seed), *key) < rate - F.floor(rate)).cast("long")
    drawn = F.struct(
        F.col(size_col).alias("size"),
        F.col(rated)["source_size"].alias("source_size"),
        F.col(rated)["target"].alias("target"),
        (F.floor(rate) + more).alias("copies"),
    )
    return joined.select(*docs.columns, drawn.alias(into))


def mixed(docs: DataFrame, size: Column, key: Sequence[Column], **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it was drawn, columns unchanged."""
    into = fresh("mix", docs.columns)
    drawn = with_copies(docs, size, key, into=into, **options).filter(F.col(into)["copies"] > 0)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col(into)["copies"]))
    return drawn.select(*docs.columns, copy.alias(into)).drop(into)
