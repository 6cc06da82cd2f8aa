"""Hard negatives by the threshold algorithm (Fagin, Lotem, Naor 2001) over integer vectors.

Vectors are cut into blocks of bounded size. A task holds one block with one sorted list of
candidates per dimension. For an anchor the lists are read from the end that the sign of its
component calls for, all to the same depth; a row that turns up is scored in full by random
access; and the sum of the anchor's components times the values last read bounds every row
not yet seen. Reading stops once that bound is strictly below the k-th score of each window
asked for, or below the window itself. A first pass finds the positives, which set the
windows of the second. What the blocks give out is merged by ranks, a few rows per anchor,
window and block.

Rows of one label with equal vectors score alike, so only the first few of their ids can ever
be asked for: a vector that many rows share is one candidate, and one question.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storygraph.session import materialize

BLOCK_ROWS = 32_768
FIRST_DEPTH = 16
LARGEST = float(1 << 20)  # components from here on might lead to scores beyond 64 bits
EXACT = 1 << 53


class Lists:
    """A block of integer vectors with a sorted list per dimension."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(x, self.order, axis=0)
        self.most = int(np.abs(x).max(initial=0))
        self.fast = x.astype(np.float64)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.most * int(np.abs(anchor).max(initial=0)) * len(anchor) < EXACT:
            return (self.fast[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.x[rows] @ anchor

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """(rows seen for the first time, their scores, bound of all others; None when there are no others), deeper and deeper."""
        n = len(self.x)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        at, end = 0, min(n, FIRST_DEPTH)
        while at < n and (len(up) or len(down)):
            hit = np.zeros(n, bool)
            hit[self.order[n - end : n - at][:, up]] = True
            hit[self.order[at:end][:, down]] = True
            rows = np.flatnonzero(hit & ~seen)
            seen |= hit
            if seen.all():
                break
            bound = int(anchor[up] @ self.values[n - end, up] + anchor[down] @ self.values[end - 1, down])
            yield rows, self.scores(rows, anchor), bound
            at, end = end, min(n, 3 * end)
        else:
            rows = np.flatnonzero(~seen)
        yield rows, self.scores(rows, anchor), None


def best_rows(lists: Lists, anchor: np.ndarray, k: int, windows: np.ndarray | None = None, share: tuple[int, int] = (0, 1)) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, scores) of the k best rows of each window, equal scores by row number.

    A window holds the scores s with share * top <= s <= top, for a top in ``windows``; without
    windows there is one that holds everything.
    """
    low, high = share
    tops = [None] if windows is None else windows.tolist()
    least = None if windows is None else min(-(-top * low // high) for top in tops)
    rows, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for fresh, got, bound in lists.read(anchor):
        if least is not None:
            inside = (got >= least) & (got <= max(tops))
            fresh, got = fresh[inside], got[inside]
        rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, got])
        if windows is None and len(scores) > 4 * k + 64:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[keep], scores[keep]
        done = bound is None
        if not done:
            done = True
            for top in tops:
                ours = scores if top is None else scores[(scores <= top) & (scores * high >= top * low)]
                full = len(ours) >= k and bound < np.partition(ours, len(ours) - k)[len(ours) - k]
                if not (full or (top is not None and bound * high < top * low)):
                    done = False
                    break
        if done:
            break
    for top in tops:
        inside = np.arange(len(rows)) if top is None else np.flatnonzero((scores <= top) & (scores * high >= top * low))
        first = inside[np.lexsort((rows[inside], -scores[inside]))[:k]]
        found.append((rows[first], scores[first]))
    return found


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up with zeros."""
    sizes = np.asarray(pa.compute.list_value_length(column).to_numpy(), np.int64)
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _grid(questions: DataFrame, vectors: DataFrame, question_blocks: int, vector_blocks: int, kernel, schema: str) -> DataFrame:
    """``kernel(questions, vectors)`` on each pair of a block of questions and a block of vectors."""

    def dealt(df: DataFrame, key: str, mine: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
        return df.withColumn(mine, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = dealt(questions, "node", "_i", question_blocks, "_j", vector_blocks)
    right = dealt(vectors, "node", "_j", vector_blocks, "_i", question_blocks)
    width = 2 * question_blocks * vector_blocks
    left, right = (df.repartition(width, "_i", "_j").groupBy("_i", "_j") for df in (left, right))
    return left.cogroup(right).applyInArrow(kernel, schema)


def hard_negatives(
    rows: DataFrame,
    anchors,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    margin: tuple[int, int] = (80, 100),
    scale: float = 256.0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the columns of ``rows``. Scores are inner products of the
    vectors, each component first floor(scale * x). An anchor's positives are its best
    ``positives`` other rows of the same label; to each belong the best ``negatives`` rows of
    other labels that score at most as much as it and at least ``margin`` of it. Equal scores
    go by smaller id. A row takes no part if its id, label or vector is null, or any component
    null, not finite or of magnitude 2 ** 20 and more. Shorter vectors count as filled up with
    zeros. Rows alike in id, label and vector count once; other rows are those of another id.
    Other columns play no part; an empty table gives an empty result.
    """
    usable = F.forall(F.col("vec"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(LARGEST)))
    clean = rows.select(
        rows[id_col].alias("id"), rows[label_col].alias("label"), rows[vec_col].cast("array<double>").alias("vec"), F.coalesce(anchors, F.lit(False)).alias("asks")
    ).filter("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    clean = clean.filter(usable).withColumn("vec", F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("long")))
    # A hash ahead of the vector, so that sorting hardly ever compares vectors.
    clean = clean.select("id", "label", F.xxhash64("vec").alias("hash"), "vec", "asks").groupBy("id", "label", "hash", "vec").agg(F.max("asks").alias("asks"))
    clean, _ = materialize(clean)
    same = ["label", "hash", "vec"]
    few = max(positives + 1, negatives)
    first = F.row_number().over(Window.partitionBy(*same).orderBy("id"))
    vectors = clean.select(*same, "id").withColumn("nth", first).filter(F.col("nth") <= few)
    vectors = vectors.groupBy(*same).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    vectors, seen = materialize(vectors.withColumn("node", F.monotonically_increasing_id()), width=F.max(F.size("vec")))
    asked = clean.filter("asks").select(F.col("id").alias("anchor_id"), *same).join(vectors.select(*same, "node"), same)
    asked, _ = materialize(asked.select("anchor_id", "node"))
    questions, put = materialize(vectors.join(asked.select("node").distinct(), "node", "left_semi").select("node", "label", "vec"))

    spark = rows.sparkSession
    n, m, width = seen["rows"], put["rows"], max(seen["width"] or 0, 1)
    cores = spark.sparkContext.defaultParallelism
    grid = max(1, math.ceil(m / block_rows)), max(1, math.ceil(n / block_rows), min(cores, math.ceil(n / 1024)))
    candidates = vectors.select("node", "label", "vec", "ids", F.col("ids")[0].alias("first"))
    id_type = rows.schema[id_col].dataType.simpleString()

    def alike(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best rows of each question's own label in this block."""
        right = right.sort_by("first")
        ours, theirs = left["label"].to_numpy(), right["label"].to_numpy()
        a, x = _matrix(left["vec"], width), _matrix(right["vec"], width)
        who, which, what = [], [], []
        for label in np.unique(ours):
            place = np.flatnonzero(theirs == label)
            if not len(place):
                continue
            lists = Lists(x[place])
            for q in np.flatnonzero(ours == label).tolist():
                ((found, scores),) = best_rows(lists, a[q], positives + 1)
                who.append(np.full(len(found), q))
                which.append(place[found])
                what.append(scores)
        return _taken(left, right, ["node"], who, which, what)

    def unlike(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best rows of other labels in each window of each question in this block."""
        right = right.sort_by("first")
        ours, theirs = left["label"].to_numpy(), right["label"].to_numpy()
        a, x = _matrix(left["vec"], width), _matrix(right["vec"], width)
        tops = left["tops"].to_pylist()
        who, which, what, top_of = [], [], [], []
        for label in np.unique(ours):
            place = np.flatnonzero(theirs != label)
            if not len(place):
                continue
            lists = Lists(x[place])
            for q in np.flatnonzero(ours == label).tolist():
                asked_for = np.array([t for t in tops[q] if t >= 0], np.int64)
                if not len(asked_for):
                    continue
                for top, (found, scores) in zip(asked_for.tolist(), best_rows(lists, a[q], negatives, asked_for, margin), strict=True):
                    who.append(np.full(len(found), q))
                    which.append(place[found])
                    what.append(scores)
                    top_of.append(np.full(len(found), top))
        out = _taken(left, right, ["node"], who, which, what)
        return out.append_column("top", pa.array(np.concatenate(top_of) if top_of else np.empty(0, np.int64)))

    near = _grid(questions, candidates, *grid, alike, f"node long, score long, ids array<{id_type}>")
    near = _ranked(near, ["node"], positives + 1)
    near, _ = materialize(near.select("node", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # An anchor is among the best of its own vector as a rule; it steps aside, and the rest move up.
    mine = Window.partitionBy("anchor_id", "node").orderBy(F.desc("positive_score"), "positive_id")
    pairs = asked.join(near, "node").filter(~F.col("anchor_id").eqNullSafe(F.col("positive_id")))
    pairs = pairs.withColumn("nth", F.row_number().over(mine)).filter(F.col("nth") <= positives).drop("nth")
    windows = questions.join(near.groupBy("node").agg(F.collect_set("positive_score").alias("tops")), "node")
    far = _grid(windows, candidates, *grid, unlike, f"node long, score long, ids array<{id_type}>, top long")
    far = _ranked(far, ["node", "top"], negatives)
    far = far.select("node", F.col("top").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(far, ["node", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _taken(left: pa.Table, right: pa.Table, keys: list[str], who: list, which: list, what: list) -> pa.Table:
    q, r, s = (pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (who, which, what))
    return pa.table({**{k: left[k].take(q) for k in keys}, "score": s, "ids": right["ids"].take(r)})


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best ids under each key over all blocks, with their rank."""
    each = found.select(*keys, "score", F.explode("ids").alias("id"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k)
