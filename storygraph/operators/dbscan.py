"""Similarity self-join and density clustering on cosine distance, in one go or as rows come in."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storygraph.functions.vectors import usable
from storygraph.operators.block_join import Blocks, Side, make_blocks, self_grid
from storygraph.operators.components import connected_components
from storygraph.operators.vector_blocks import Forest, Segments, exact_dots, similar_tiles
from storygraph.params import Params
from storygraph.session import materialize

# Float distance of vectors that are equal but for rounding may exceed a zero eps.
ROUNDING = 1e-12


def distinct_vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Collapse equal vectors: (nodes, rows, number of nodes).

    ``nodes`` (vec_key, node, copies, vec) holds one row per different vector,
    named by its smallest id; ``rows`` (id, vec_key) leads back to the input.
    Vectors without direction are left out. A group of copies, however large, is
    a combining aggregate here and a single row in the quadratic part.
    """
    rows = _usable_rows(df, id_col, vec_col).withColumn("vec_key", _vec_key())
    nodes, seen = materialize(
        rows.groupBy("vec_key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    )
    return nodes, rows.select("id", "vec_key"), seen["rows"]


def _usable_rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.filter(usable(F.col(vec_col))).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))


def _vec_key() -> Column:
    """Two 64-bit hashes under different seeds, cheaper to shuffle and compare than the vector."""
    return F.struct(F.xxhash64("vec"), F.xxhash64(F.lit(1), "vec")).cast("struct<a:bigint,b:bigint>")


def _blocks(nodes: DataFrame, n: int, eps: float, params: Params, blocks: int | None, known: str | None = None) -> Blocks:
    angle = math.acos(max(-1.0, min(1.0, 1.0 - eps - ROUNDING)))
    return make_blocks(nodes, "node", n, params.block_rows, params.index_rows, angle, blocks, known)


def eps_join(df: DataFrame, id_col: str, vec_col: str, eps: float, params: Params = Params(), blocks: int | None = None) -> DataFrame:
    """All pairs of different vectors at cosine distance <= eps.

    (left_id, right_id, left_copies, right_copies, similarity), left_id < right_id;
    an id stands for all rows that share its vector.
    """
    nodes, _, n = distinct_vectors(df, id_col, vec_col)
    id_type = nodes.schema["node"].dataType.simpleString()
    bar = 1.0 - eps - ROUNDING

    def kernel(left: Side, right: Side, same: bool, segments: Segments) -> Iterator[pa.RecordBatch]:
        a, b = left.vectors, right.vectors
        for i, j in similar_tiles(a, b, bar, same, segments):
            yield pa.RecordBatch.from_arrays(
                [
                    left["node"].take(pa.array(i)).combine_chunks(),
                    right["node"].take(pa.array(j)).combine_chunks(),
                    left["copies"].take(pa.array(i)).combine_chunks(),
                    right["copies"].take(pa.array(j)).combine_chunks(),
                    pa.array(exact_dots(a, b, i, j)),
                ],
                names=["a", "b", "a_copies", "b_copies", "similarity"],
            )

    schema = f"a {id_type}, b {id_type}, a_copies bigint, b_copies bigint, similarity double"
    pairs = self_grid(_blocks(nodes.drop("vec_key"), n, eps, params, blocks), kernel, schema)
    swap = F.col("a") > F.col("b")
    return pairs.select(
        F.least("a", "b").alias("left_id"),
        F.greatest("a", "b").alias("right_id"),
        F.when(swap, F.col("b_copies")).otherwise(F.col("a_copies")).alias("left_copies"),
        F.when(swap, F.col("a_copies")).otherwise(F.col("b_copies")).alias("right_copies"),
        "similarity",
    )


def dbscan(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    eps: float,
    min_samples: int,
    params: Params = Params(),
    blocks: int | None = None,
) -> DataFrame:
    """(id, label): label is the smallest core id of the cluster, NULL for noise.

    A point counts itself among its neighbours. With ``min_samples`` <= 2 every
    clustered point is a core point and clusters are the components of the
    eps-graph; otherwise one pass counts neighbours and a second one links.
    """
    nodes, rows, n = distinct_vectors(df, id_col, vec_col)
    placed = _blocks(nodes, n, eps, params, blocks)
    bar = 1.0 - eps - ROUNDING
    if min_samples <= 2:
        labelled = _by_components(nodes, placed, bar, min_samples)
    else:
        labelled, _ = _general(nodes, placed, bar, min_samples)
    return _labels(df, id_col, vec_col, rows, labelled)


def _labels(df: DataFrame, id_col: str, vec_col: str, rows: DataFrame, labelled: DataFrame) -> DataFrame:
    clustered = labelled.filter("label is not null").select("vec_key", "label")
    found = rows.join(clustered, "vec_key", "left").select(F.col("id").alias(id_col), "label")
    unusable = df.filter(~usable(F.col(vec_col))).select(id_col, F.lit(None).cast(labelled.schema["label"].dataType).alias("label"))
    return found.unionByName(unusable)


@dataclass
class Density:
    """What an incremental clustering knows of the rows so far.

    ``points``: id, vec, weight (rows within eps, itself included), core, label. ``links``: a, b,
    the pairs of ids within eps of which at least one is no core point; as such a row has
    fewer than min_samples neighbours, there are fewer than that many for each of them.
    ``compared`` rows took part in the last search, ``fresh`` of them were new.
    """

    points: DataFrame
    links: DataFrame
    fresh: int = 0
    compared: int = 0


def empty_density(like: DataFrame, id_col: str) -> Density:
    spark, kind = like.sparkSession, like.schema[id_col].dataType.simpleString()
    points = spark.createDataFrame([], f"id {kind}, vec array<float>, weight bigint, core boolean, label {kind}")
    return Density(points, spark.createDataFrame([], f"a {kind}, b {kind}"))


def grow(state: Density, rows: DataFrame, id_col: str, vec_col: str, eps: float, min_samples: int, params: Params = Params(), blocks: int | None = None) -> Density:
    """The state after more rows: the same labels as ``dbscan`` over all rows at once.

    Only pairs with a new vector are searched. A stored row's neighbours are on record as far
    as they can matter: their number, and which they are while it is no core point. So a row
    that new neighbours make a core point finds its old ones there, and stored clusters come
    in as one edge per core point. Ids are unique and new; rows without direction are left out.
    """
    kind = state.points.schema["id"].dataType.simpleString()
    new = _usable_rows(rows, id_col, vec_col).withColumn("id", F.col("id").cast(kind))
    new = new.withColumns({"weight": F.lit(0).cast("bigint"), "core": F.lit(False), "label": F.lit(None).cast(kind), "known": F.lit(False)})
    both = state.points.select("id", "vec", "weight", "core", "label").withColumn("known", F.lit(True)).unionByName(new)
    both = both.withColumn("vec_key", _vec_key())
    # Equal vectors are one node. One that is known keeps its name, which clusters refer to.
    first = F.coalesce(F.min(F.when(F.col("known"), F.col("id"))), F.min("id"))
    nodes, seen = materialize(
        both.groupBy("vec_key").agg(
            first.alias("node"),
            F.min("id").alias("low"),
            F.count(F.lit(1)).alias("copies"),
            F.count_if(~F.col("known")).alias("added"),
            F.first("vec").alias("vec"),
            F.min("known").alias("known"),
            F.max("weight").alias("weight"),
            F.max("core").alias("was_core"),
            F.max("label").alias("label"),
        ),
        known=F.count_if(F.col("known")),
        fresh=F.sum("added"),
        all=F.sum("copies"),
    )
    named = both.select("id", "vec_key").join(nodes.select("vec_key", "node"), "vec_key").select("id", "node")
    known = "known" if seen["known"] else None
    placed = _blocks(nodes.select("node", "vec", "known", "copies", "added"), seen["rows"], eps, params, blocks, known)
    bar = 1.0 - eps - ROUNDING
    if min_samples <= 2:
        found = _by_components(nodes, placed, bar, min_samples)
        found = found.withColumns({"core": F.col("label").isNotNull(), "weight": F.greatest("weight", "copies")})
        links = state.links.limit(0)
    else:
        ends = state.links.join(named.toDF("a", "src"), "a").join(named.toDF("b", "dst"), "b").filter("src <> dst")
        found, links = _general(nodes, placed, bar, min_samples, ends.select("src", "dst").distinct())
        across = links.join(named.toDF("a", "src"), "src").join(named.toDF("b", "dst"), "dst").select("a", "b")
        # Equal vectors that are no core points are fewer than min_samples.
        alike = named.join(found.filter("not core and copies > 1").select("node"), "node")
        alike = alike.toDF("node", "a").join(alike.toDF("node", "b"), "node").filter("a < b").select("a", "b")
        links, _ = materialize(across.unionByName(alike))
    out = both.select("id", "vec", "vec_key").join(found.select("vec_key", "weight", "core", "label"), "vec_key")
    out, _ = materialize(out.select("id", "vec", "weight", "core", "label"))
    return Density(out, links, seen["fresh"] or 0, seen["all"] or 0)


def _by_components(nodes: DataFrame, placed: Blocks, bar: float, min_samples: int) -> DataFrame:
    """``nodes`` with their label, where every neighbour of a row is in its cluster."""
    id_type = nodes.schema["node"].dataType.simpleString()
    # Written out, so that a task of it does not hold a second Python process for the components.
    links, _ = materialize(self_grid(placed, _forest_kernel(bar), f"src {id_type}, dst {id_type}", waves=True))
    if "label" in nodes.columns:
        links = links.unionByName(nodes.filter("known").select(F.col("node").alias("src"), F.col("label").alias("dst")).filter("dst is not null"))
    parts = nodes.drop("label").join(connected_components(links), "node", "left")
    labelled = parts.withColumn("label", F.coalesce("component", F.when(F.col("copies") >= min_samples, F.col("node")))).drop("component")
    return _lowest(labelled) if "low" in nodes.columns else labelled


def _lowest(labelled: DataFrame) -> DataFrame:
    """Clusters named by the smallest id of their core points instead of the smallest name of a node."""
    labelled, _ = materialize(labelled)
    names = labelled.filter("label is not null").groupBy("label").agg(F.min("low").alias("lowest"))
    return labelled.join(names, "label", "left").drop("label").withColumnRenamed("lowest", "label")


def _forest_kernel(bar: float):
    def kernel(left: Side, right: Side, same: bool, segments: Segments) -> Iterator[pa.RecordBatch]:
        a, b = left.vectors, right.vectors
        shift = 0 if same else len(a)
        forest = Forest(len(a) + (0 if same else len(b)))
        for i, j in similar_tiles(a, b, bar, same, segments, forest.joined(shift)):
            forest.add(i, j + shift)
        ids = left["node"] if same else pa.chunked_array(left["node"].chunks + right["node"].chunks)
        child = np.flatnonzero(forest.root != np.arange(len(forest.root)))
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(child)).combine_chunks(), ids.take(pa.array(forest.root[child])).combine_chunks()],
            names=["src", "dst"],
        )

    return kernel


def _general(nodes: DataFrame, placed: Blocks, bar: float, min_samples: int, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Core test, components of the core points, then border points: (nodes with weight, core and label, links).

    Without a state the weight of a core point is a lower bound of its neighbours.

    With ``stored`` links (src, dst) the nodes come from a state: pairs of known ones are not
    searched, and ``links`` (src, dst) are all pairs of which one row at least is no core
    point. Otherwise ``links`` are empty.
    """
    id_type = nodes.schema["node"].dataType.simpleString()
    incremental = stored is not None

    def neighbours(left: Side, right: Side, same: bool, segments: Segments) -> Iterator[pa.RecordBatch]:
        a, b = left.vectors, right.vectors
        # What is known counts its old neighbours already, so it gains only what is added.
        from_left, from_right = (t["added" if incremental and o["known"][0].as_py() else "copies"].to_numpy() for t, o in ((left, right), (right, left)))
        left_sum, right_sum = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)

        def cores(r: int, r_end: int, c: int, c_end: int) -> tuple[np.ndarray, np.ndarray]:
            """Rows found to be core points: how many more neighbours they have does not matter."""
            found = []
            for side, sums, other, s in ((left, left_sum, right_sum, slice(r, r_end)), (right, right_sum, left_sum, slice(c, c_end))):
                found.append(side["copies"].to_numpy()[s] + sums[s] + (other[s] if same else 0) >= min_samples)
            return found[0], found[1]

        # A state keeps the number of all neighbours.
        for i, j in similar_tiles(a, b, bar, same, segments, None if incremental else cores):
            np.add.at(left_sum, i, from_right[j])
            np.add.at(right_sum, j, from_left[i])
        sides = [(left, left_sum + right_sum)] if same else [(left, left_sum), (right, right_sum)]
        for table, sums in sides:
            hit = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [table["node"].take(pa.array(hit)).combine_chunks(), pa.array(sums[hit])], names=["node", "more"]
            )

    degree = self_grid(placed, neighbours, f"node {id_type}, more bigint", waves=True).groupBy("node").agg(F.sum("more").alias("more"))
    own = F.when(F.col("known"), F.col("weight")).otherwise(F.col("copies")) if incremental else F.col("copies")
    weighed = nodes.join(degree, "node", "left").withColumn("weight", own + F.coalesce("more", F.lit(0))).drop("more")
    flagged, _ = materialize(weighed.withColumn("core", F.col("weight") >= min_samples))

    def links(left: Side, right: Side, same: bool, segments: Segments) -> Iterator[pa.RecordBatch]:
        a, b = left.vectors, right.vectors
        shift = 0 if same else len(a)
        ids = left["node"] if same else pa.chunked_array(left["node"].chunks + right["node"].chunks)
        core = left["core"].to_numpy() if same else np.concatenate([left["core"].to_numpy(), right["core"].to_numpy()])
        forest = Forest(len(core))
        touching: set[tuple[int, int]] = set()
        open_pairs: list[np.ndarray] = []
        for i, j in similar_tiles(a, b, bar, same, segments, forest.joined(shift, core)):
            j = j + shift
            inner = core[i] & core[j]
            forest.add(i[inner], j[inner])
            if incremental:
                # Kept as they are: each row that is no core point has fewer than min_samples of them.
                open_pairs.append(np.stack([i[~inner], j[~inner]], axis=1))
                continue
            edge = core[i] != core[j]
            border = np.where(core[i[edge]], j[edge], i[edge])
            centre = np.where(core[i[edge]], i[edge], j[edge])
            # One core per part found so far is enough for a border point.
            seen = np.unique(np.stack([border, forest.root[centre]], axis=1), axis=0)
            touching.update(map(tuple, seen.tolist()))
        child = np.flatnonzero(forest.root != np.arange(len(forest.root)))
        near = np.array(sorted({(p, int(forest.root[c])) for p, c in touching}), dtype=np.int64).reshape(-1, 2)
        near = np.concatenate([near, *open_pairs])
        src = np.concatenate([child, near[:, 0]])
        dst = np.concatenate([forest.root[child], near[:, 1]])
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(src)).combine_chunks(),
                ids.take(pa.array(dst)).combine_chunks(),
                pa.array(np.arange(len(src)) >= len(child)),
            ],
            names=["src", "dst", "loose"],
        )

    again = placed.with_columns(flagged.select("node", "core"), "node")
    found, _ = materialize(self_grid(again, links, f"src {id_type}, dst {id_type}, loose boolean", waves=True))
    inner, loose = found.filter("not loose").select("src", "dst"), found.filter("loose").select("src", "dst")
    if incremental:
        cores_only = flagged.select("node", "core")
        both = loose.unionByName(stored).distinct()
        both = both.join(cores_only.toDF("src", "c"), "src").join(cores_only.toDF("dst", "d"), "dst")
        both, _ = materialize(both.select("src", "dst", "c", "d"))
        # Stored clusters: each of their core points, and the one that names them.
        stars = flagged.filter("was_core").select(F.col("node").alias("src"), F.col("label").alias("dst"))
        inner = inner.unionByName(stars).unionByName(both.filter("c and d").select("src", "dst"))
        left_open = both.filter("not (c and d)").select("src", "dst")
        border = both.filter("c <> d").select(F.expr("if(c, dst, src)").alias("src"), F.expr("if(c, src, dst)").alias("dst"))
    else:
        left_open, border = loose.limit(0), loose
    flagged = flagged.drop("label")
    parts = connected_components(inner)
    cores = flagged.filter("core").join(parts, "node", "left").withColumn("label", F.coalesce("component", "node"))
    cores = (_lowest(cores) if "low" in cores.columns else cores).select("node", "label")
    borders = (
        border.join(cores.withColumnRenamed("node", "dst"), "dst")
        .groupBy(F.col("src").alias("node"))
        .agg(F.min("label").alias("label"))
    )
    return flagged.join(cores.unionByName(borders), "node", "left"), left_open
