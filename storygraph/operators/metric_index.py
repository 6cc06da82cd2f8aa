"""Blocks of unit vectors around pivots, and the pairs of blocks that can hold a match.

Pivots are vectors of the data. Each vector goes to its nearest pivot; a pivot keeps how many
it has and the largest angle to any of them. Angles obey the triangle inequality, so two
pivots farther apart than both radii and the angle asked for have no pair between them.
Small neighbouring pivots share a bin, which is what a task loads; a pivot that holds more
rows than a task may is cut by hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storygraph.operators.vector_blocks import best_match, to_matrix
from storygraph.session import materialize

PIVOTS = 1024
SLACK = 1e-6  # of angles, far above what arc cosines of rounded products are off


def angles(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(left @ right.T, -1.0, 1.0))


def choose_pivots(rows: DataFrame, key: str, n: int, most: int = PIVOTS) -> np.ndarray:
    """About 2 sqrt(n) vectors of the data, as unit rows in a chain of neighbours.

    Out of a sample by a hash of the key, of a bounded size, each next pivot is the vector
    farthest from those chosen, so every group that the sample holds has one of its own.
    """
    root = max(1, math.ceil(math.sqrt(n)))
    sample = rows.select(key, "vec").orderBy(F.xxhash64(key), key).limit(min(16 * most, 8 * root))
    found = to_matrix(sample.toArrow()["vec"])
    nearest = np.full(len(found), -np.inf)
    picked = [0]
    for _ in range(min(most, 2 * root, len(found)) - 1):
        nearest = np.maximum(nearest, found @ found[picked[-1]])
        picked.append(int(nearest.argmin()))
    found = found[picked]
    chain, left = [0], np.ones(len(found), bool)
    left[0] = False
    sims = found @ found.T
    while left.any():
        chain.append(int(np.where(left, sims[chain[-1]], -np.inf).argmax()))
        left[chain[-1]] = False
    return found[chain]


def with_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with ``_pivot``, the place of the nearest pivot, and ``_angle``, how far it is."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest, sims = best_match(to_matrix(batch.column("vec")), shared.value)
                far = np.arccos(np.clip(sims, -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(far)], [*batch.schema.names, "_pivot", "_angle"])

    return rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("_pivot", T.IntegerType()), T.StructField("_angle", T.DoubleType())]))


@dataclass(frozen=True)
class MetricIndex:
    """``bins`` and ``parts`` tell the bin of each pivot and into how many parts a bin is cut."""

    pivots: np.ndarray
    radius: np.ndarray
    counts: np.ndarray
    bins: np.ndarray
    parts: np.ndarray

    @property
    def blocks(self) -> int:
        return int(self.parts.sum())

    def first_blocks(self) -> np.ndarray:
        """The first block of each bin; a bin has as many as it has parts."""
        return np.r_[0, np.cumsum(self.parts)][:-1]

    def bin_angles(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector and bin an angle that no vector of the bin is nearer than."""
        least = np.where(self.counts > 0, angles(vectors, self.pivots) - self.radius - SLACK, np.inf)
        starts = np.flatnonzero(np.r_[True, np.diff(self.bins) > 0])
        return np.maximum(np.minimum.reduceat(least, starts, axis=1), 0.0)

    def reach(self, angle: float) -> np.ndarray:
        """Which pairs of pivots can hold two vectors within ``angle``."""
        apart = angles(self.pivots, self.pivots)
        near = apart <= self.radius[:, None] + self.radius[None, :] + angle + SLACK
        return near & (self.counts > 0)[:, None] & (self.counts > 0)[None, :]

    def bin_pairs(self, reach: np.ndarray) -> list[tuple[int, int]]:
        starts = np.flatnonzero(np.r_[True, np.diff(self.bins) > 0])
        between = np.logical_or.reduceat(np.logical_or.reduceat(reach, starts, axis=0), starts, axis=1)
        return list(zip(*(x.tolist() for x in np.nonzero(between)), strict=True))

    def compared(self, reach: np.ndarray) -> int:
        """Pairs of rows that lie in reach of each other's pivots, the rest being skipped unseen."""
        c = self.counts.astype(np.int64)
        return int((np.triu(reach, 1) * np.outer(c, c)).sum() + (np.diag(reach) * c * (c - 1) // 2).sum())


def build_metric_index(rows: DataFrame, key: str, n: int, block_rows: int) -> tuple[DataFrame, MetricIndex]:
    """``rows`` (with ``vec``) with ``_pivot``, and their index."""
    pivots = choose_pivots(rows, key, n)
    placed, _ = materialize(with_pivots(rows, pivots))
    stats = placed.groupBy("_pivot").agg(F.count(F.lit(1)).alias("n"), F.max("_angle").alias("radius")).toArrow()
    counts, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    counts[stats["_pivot"].to_numpy()] = stats["n"].to_numpy()
    radius[stats["_pivot"].to_numpy()] = stats["radius"].to_numpy()
    bins, parts, size = [], [], 0
    for count in counts.tolist():
        if not parts or size + count > block_rows:
            parts.append(1)
            size = 0
        size += count
        bins.append(len(parts) - 1)
        parts[-1] = max(1, math.ceil(size / block_rows))
    return placed.drop("_angle"), MetricIndex(pivots, radius, counts, np.array(bins), np.array(parts))
