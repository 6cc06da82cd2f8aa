"""Exact all-against-all work on vectors, cut into pairs of blocks.

Up to ``index_rows`` rows a row's block is a hash of its key, so blocks are even whatever the
data looks like, and every pair of blocks is a task. Beyond, blocks are neighbourhoods of
pivots, and a pair of them is a task only if the triangle inequality leaves a match possible.
A task holds just two blocks. Rows marked as known need not meet each other: what links them
is on record, so only pairs of blocks with a new row are tasks. What a task returns is up to
the caller: matching pairs, per-row counts, or a spanning forest (at most one edge per row),
so a dense neighbourhood does not turn into all of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storygraph.operators.metric_index import MetricIndex, build_metric_index
from storygraph.operators.vector_blocks import Segments, Vectors
from storygraph.session import materialize

# Copies of the rows that are dealt out at a time where many blocks meet.
COPIES = 8


def block_count(rows: int, block_rows: int, parallelism: int) -> int:
    """Blocks needed for the memory bound, and enough of them to keep all cores busy."""
    by_memory = math.ceil(rows / block_rows)
    by_cores = min(math.ceil(math.sqrt(2 * parallelism)), math.ceil(rows / 256))
    return max(1, by_memory, by_cores)


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


@dataclass
class Blocks:
    """Rows with their block, and which blocks meet.

    ``rows`` carry ``_block`` and, with an index, ``_pivot``. Blocks from ``total`` on repeat the
    first ``total`` ones for the rows that are known.
    """

    rows: DataFrame
    total: int
    known: str | None = None
    index: MetricIndex | None = None
    reach: np.ndarray | None = None

    def spread(self) -> DataFrame:
        """Each row once for every task it takes part in: (_block, _bi, _bj)."""
        fresh = F.lit(True) if self.known is None else ~F.col(self.known)
        placed = self.rows.withColumn("_block", F.when(fresh, F.col("_block")).otherwise(F.col("_block") + self.total))
        if self.index is None:
            others = F.sequence(F.lit(0), F.lit(self.total - 1))
            met = placed.withColumn("_other", F.explode(others))
        else:
            met = placed.join(F.broadcast(self._partners()), "_bin").withColumn("_other", F.explode(F.sequence("_first", F.col("_first") + F.col("_parts") - 1)))
            met = met.drop("_bin", "_first", "_parts")
        if self.known is not None:
            # Known rows meet new ones only; new rows meet both.
            sides = F.when(fresh, F.array(F.lit(0), F.lit(self.total))).otherwise(F.array(F.lit(0)))
            met = met.withColumn("_side", F.explode(sides)).withColumn("_other", F.col("_other") + F.col("_side")).drop("_side")
        return met.select("*", F.least("_block", "_other").alias("_bi"), F.greatest("_block", "_other").alias("_bj")).drop("_other")

    def _partners(self) -> DataFrame:
        """(_bin, _first, _parts): the blocks of the bins within reach of a bin. One row per pair of bins, 1024 by 1024 at most."""
        first = self.index.first_blocks()
        pairs = self.index.bin_pairs(self.reach)
        rows = pa.table(
            {
                "_bin": pa.array([i for i, _ in pairs], pa.int32()),
                "_first": pa.array([int(first[j]) for _, j in pairs], pa.int32()),
                "_parts": pa.array([int(self.index.parts[j]) for _, j in pairs], pa.int32()),
            }
        )
        return self.rows.sparkSession.createDataFrame(rows)

    def with_columns(self, more: DataFrame, key: str) -> Blocks:
        """The same blocks with columns looked up by ``key``."""
        slim = self.rows.select(key, "vec", *[c for c in (self.known, "_block", "_bin", "_pivot") if c in self.rows.columns])
        return Blocks(slim.join(more, key), self.total, self.known, self.index, self.reach)

    def turns(self) -> list[tuple[int, int]]:
        """Ranges of left blocks whose pairs hold about ``COPIES`` copies of the rows, if all blocks meet."""
        n = self.total * (2 if self.known else 1)
        out, first, copies = [], 0, 0.0
        for block in range(n):
            copies += 2 * (n - block) / n
            if copies >= COPIES or block == n - 1:
                out.append((first, block))
                first, copies = block + 1, 0.0
        return out

    def tasks(self) -> int:
        n = self.total * (2 if self.known else 1)
        return n * (n + 1) // 2


def make_blocks(rows: DataFrame, key: str, n: int, block_rows: int, index_rows: int, angle: float, blocks: int | None = None, known: str | None = None) -> Blocks:
    """Blocks of ``n`` rows (with ``vec``) for a join within ``angle``; ``blocks`` asks for so many by hash."""
    if blocks or n <= index_rows:
        total = blocks or block_count(n, block_rows, rows.sparkSession.sparkContext.defaultParallelism)
        return Blocks(rows.withColumn("_block", block_of(F.col(key), total)), total, known)
    # No larger than leaves each core a pair of blocks.
    busy = block_count(n, block_rows, rows.sparkSession.sparkContext.defaultParallelism)
    placed, index = build_metric_index(rows, key, n, min(block_rows, math.ceil(n / busy)))
    return Blocks(with_blocks(placed, key, index), index.blocks, known, index, index.reach(angle))


def with_blocks(placed: DataFrame, key: str, index: MetricIndex) -> DataFrame:
    """Rows that know their ``_pivot`` with the ``_bin`` of that pivot and their ``_block`` in it."""
    first = index.first_blocks()
    bins = pa.table(
        {
            "_pivot": pa.array(range(len(index.bins)), pa.int32()),
            "_bin": pa.array(index.bins, pa.int32()),
            "_begin": pa.array(first[index.bins], pa.int32()),
            "_cut": pa.array(index.parts[index.bins], pa.int32()),
        }
    )
    named = placed.join(F.broadcast(placed.sparkSession.createDataFrame(bins)), "_pivot")
    part = F.pmod(F.xxhash64(key), F.col("_cut")).cast("int")
    return named.withColumn("_block", F.col("_begin") + part).drop("_begin", "_cut")


@dataclass
class Side:
    """One block of a task: its vectors, and the other columns of its rows in the same order."""

    columns: pa.Table
    vectors: Vectors

    def __getitem__(self, name: str) -> pa.ChunkedArray:
        return self.columns[name]

    def __len__(self) -> int:
        return len(self.vectors)


Kernel = Callable[[Side, Side, bool, Segments], Iterator[pa.RecordBatch]]


def _sides(table: pa.Table, pairs_of_pivots: bool) -> tuple[Side, Side, bool] | None:
    """The two blocks of a group of ``self_grid``, sorted by pivot, as copies: what Spark sent can go."""
    block = table["_block"].to_numpy()
    ends = (table["_bi"][0].as_py(), table["_bj"][0].as_py())
    same = ends[0] == ends[1]
    sides = []
    for end in ends[: 1 if same else 2]:
        at = np.flatnonzero(block == end)
        if not len(at):
            return None
        if pairs_of_pivots:
            at = at[np.argsort(table["_pivot"].to_numpy()[at], kind="stable")]
        sides.append(Side(table.drop_columns("vec").take(pa.array(at)), Vectors.of(table["vec"], at)))
    return sides[0], sides[-1], same


def self_grid(blocks: Blocks, kernel: Kernel, schema: str, waves: bool = False) -> DataFrame:
    """Run ``kernel(left, right, same, segments)`` on each pair of blocks that meet.

    A row is dealt out once for each block that its own one meets. ``waves``, for kernels that return
    little: pairs of blocks go through in turns of about ``COPIES`` copies of the rows, each written
    out, and what one has dealt out is gone before the next.
    """
    reach = None if blocks.reach is None else blocks.rows.sparkSession.sparkContext.broadcast(blocks.reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _sides(pa.Table.from_batches(list(batches)), reach is not None)
        if met is None:
            return
        # What Spark sent is copied: its memory goes back to the system, not to a pool that an idle process keeps.
        pa.default_memory_pool().release_unused()
        left, right, same = met
        segments = Segments(len(left), len(right))
        if reach is not None:
            segments = Segments(len(left), len(right), left["_pivot"].to_numpy(), right["_pivot"].to_numpy(), reach.value)
        yield from kernel(left, right, same, segments)

    def met(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(_width(blocks.rows, blocks.tasks()), "_bi", "_bj")
        return dealt.groupBy("_bi", "_bj").applyInArrow(run, schema)

    turns = blocks.turns() if waves else []
    if len(turns) < 2:
        return met(blocks.spread())
    done = [materialize(met(blocks.spread().filter(F.col("_bi").between(first, last))))[0] for first, last in turns]
    return reduce(DataFrame.unionByName, done)


def _width(df: DataFrame, tasks: int) -> int:
    """Shuffle width for ``tasks`` equal groups: spread them, but stay within what a driver tracks well."""
    return int(min(max(tasks, 1) * 4, max(df.sparkSession.sparkContext.defaultParallelism * 8, 2000)))
