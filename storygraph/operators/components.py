"""Connected components of an edge table: every edge partition shrinks to a forest before
anything is shuffled, then alternating large-star and small-star steps (Kiveris et al.,
Connected Components in MapReduce and Beyond, 2014) join the forests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storygraph.operators.vector_blocks import Forest
from storygraph.session import materialize

# Edges contracted at a time, or so many bytes of them, which bounds the memory of a task.
CHUNK = 1 << 20
CHUNK_BYTES = 64 << 20
# Forests of at most so many edges, counted while written, are joined by one last pass of the same kind.
LAST = 500_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100, last: int = LAST) -> DataFrame:
    """(node, component) with the smallest node of each component as its name.

    Nodes without an edge do not appear. Each partition of edges is first replaced by its
    spanning stars, at most one edge per node. A step takes the minimum per node as a
    combining aggregate and joins it back, so the star around a hot centre is never one group
    in one task; steps are written out, which cuts the lineage, and the end is seen from a
    digest of the edges taken while they are written.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    current, seen = _written(contracted(pairs))
    for _ in range(max_rounds):
        if seen["rows"] <= last:
            # Forests of a proven size: one task sees them all, and its stars are the components.
            current = contracted(current.coalesce(1), max(last, 1), chunk_bytes=math.inf)
            break
        before = seen
        stars, _ = _written(contracted(_large_star(current)))
        current, seen = _written(contracted(_small_star(stars)).distinct())
        if seen == before:
            break
    else:
        raise RuntimeError(f"no stable components after {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def contracted(edges: DataFrame, chunk: int = CHUNK, *, chunk_bytes: float = CHUNK_BYTES) -> DataFrame:
    """Edges (u, v) of the same components: from each node of a chunk to the smallest one it reaches within the chunk."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = size = 0
        for batch in batches:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n >= chunk or size >= chunk_bytes:
                yield stars(held)
                held, n, size = [], 0, 0
        if n:
            yield stars(held)

    schema = edges.schema
    return edges.filter("u <> v").mapInArrow(shrink, schema)


def stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    u, v = (pa.concat_arrays([b.column(i) for b in batches]) for i in (0, 1))
    names = pa.concat_arrays([u, v]).unique()
    names = names.take(pc.array_sort_indices(names))
    i, j = (pc.index_in(c, value_set=names).to_numpy().astype(np.int64) for c in (u, v))
    forest = Forest(len(names))
    forest.add(i, j)
    child = np.flatnonzero(forest.root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([names.take(pa.array(child)), names.take(pa.array(forest.root[child]))], ["u", "v"])


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    digest = F.xxhash64("u", "v")
    return materialize(edges, a=F.bit_xor(digest), b=F.bit_xor(F.xxhash64(digest, "v")))


def _clean(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller node, each once."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return _clean(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    # The row of the smallest neighbour itself stands for the node.
    moved = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return _clean(edges.join(least, "u").select(moved.alias("u"), F.col("m").alias("v")))
