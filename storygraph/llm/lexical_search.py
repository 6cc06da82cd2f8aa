"""Ranked lexical search over a length-stratified index.

A document's score depends on its length through its normaliser m alone, so documents of equal
m form a stratum, kept in blocks of bounded size; within a block the postings of a term are
grouped by tf. The impact of a (tf, m) is computed once for such a group, and the largest tf of
each term bounds what any document of the block can score. A question first visits the few
blocks of the highest bounds, which gives it a threshold, then all others in the order of their
bounds until these fall strictly below the k-th score so far. Documents are read once per
group of questions, whose terms have a bounded number.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storygraph.llm.columns import fresh
from storygraph.session import materialize

BLOCK_DOCS = 2048
GROUP_TERMS = 100_000  # terms of questions answered together, which are broadcast
TOP = 50
BOUNDS = 2_000_000  # of blocks and questions held at a time
# A term is a run of ASCII letters and digits and of all other characters beyond ASCII; A-Z are lower-cased.
TABLE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def question_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, text, terms) of the different rows of a table of questions, each term once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({t.decode("utf-8", "surrogatepass") for t in terms_of(x)}) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], ["item", "terms"])

    rows = items.select(items[id_col].alias("item"), items[text_col].alias("text")).distinct()
    return rows.mapInArrow(split, f"item {rows.schema['item'].dataType.simpleString()}, terms array<string>")


def counted_documents(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """(row, id, n, terms, tfs) of every row, by number in the vocabulary; how many rows hold a term at all; terms with repeats."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, terms, tfs, ends = [], [], [], [0]
            for text in batch.column(2):
                words = terms_of(text.as_py())
                counts = Counter(words)
                for word in counts.keys() & known.keys():
                    terms.append(known[word])
                    tfs.append(counts[word])
                n.append(len(words))
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *lists], ["row", "id", "n", "terms", "tfs"])

    kind = rows.schema["id"].dataType.simpleString()
    counted, seen = materialize(
        rows.mapInArrow(count, f"row long, id {kind}, n long, terms array<int>, tfs array<int>"), documents=F.count_if(F.col("n") > 0), terms=F.sum("n")
    )
    return counted, seen["documents"] or 0, seen["terms"] or 0


def build_index(counted: DataFrame, n_docs: int, n_terms: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(block, m, ids, term, tf, end, docs): documents of one normaliser, with their postings.

    ``term`` and ``tf`` name the groups of postings in order, ``end`` where each ends in
    ``docs``, the places within ``ids``. Rows are dealt by ranges of m and id, so a stratum that
    holds most documents is many blocks in many tasks. Documents without any term of the
    vocabulary are in no block.
    """
    m = F.lit(100 - 50) + F.expr(f"(50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    rows = counted.filter(F.size("terms") > 0).withColumn("m", m)
    order = [F.col("m"), F.col("id").asc_nulls_last(), F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("m", "id", "row", "terms", "tfs")

    def made(m: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        sizes = pa.compute.list_value_length(table["terms"]).to_numpy()
        term, tf = (table[c].combine_chunks().flatten().to_numpy() for c in ("terms", "tfs"))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((doc, tf, term))
        term, tf, doc = term[order], tf[order], doc[order]
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])
        ends = np.r_[first[1:], len(term)]

        def one(values, kind):
            return pa.array([values], pa.list_(kind))

        ids = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table["id"].combine_chunks())
        numbers = [one(x, pa.int32()) for x in (term[first], tf[first], ends, doc)]
        # The first row of a block is in no other one and names it.
        return pa.RecordBatch.from_arrays([table["row"][:1].combine_chunks(), pa.array([m], pa.int64()), ids, *numbers], ["block", "m", "ids", "term", "tf", "end", "docs"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, size = None, 0
        for batch in batches:
            ms = batch.column(0).to_numpy()
            at = 0
            while at < len(ms):
                if held and (ms[at] != last or size == block_docs):
                    yield made(int(last), held)
                    held, size = [], 0
                last = ms[at]
                end = min(int(np.searchsorted(ms, last, side="right")), at + block_docs - size)
                held.append(batch.slice(at, end - at))
                size += end - at
                at = end
        if held:
            yield made(int(last), held)

    kind = counted.schema["id"].dataType.simpleString()
    schema = f"block long, m long, ids array<{kind}>, term array<int>, tf array<int>, end array<int>, docs array<int>"
    return materialize(dealt.mapInArrow(cut, schema))[0]


class Questions:
    """Terms of the questions as numbers, flattened, with the weight of each term."""

    def __init__(self, terms: list[list[int]], weights: np.ndarray):
        self.terms = [np.array(t, np.int64) for t in terms]
        self.flat = np.concatenate([*self.terms, np.empty(0, np.int64)]).astype(np.int64)
        self.of = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        self.weights = weights

    def bounds(self, m: int, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """The most that a document of a block can score, for each question; groups are sorted by term, then tf."""
        last = np.flatnonzero(np.r_[term[1:] != term[:-1], True])
        most = np.zeros(len(self.weights), np.int64)
        most[term[last]] = self.weights[term[last]] * impact(tf[last], m)
        out = np.zeros(len(self.terms), np.int64)
        np.add.at(out, self.of, most[self.flat])
        return out


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Block:
    """One block of the index, ready to score its documents."""

    def __init__(self, row: dict, weights: np.ndarray):
        self.term, self.end, self.docs = row["term"], row["end"], row["docs"]
        self.size = row["size"]
        begin = np.r_[0, self.end[:-1]]
        value = weights[self.term] * impact(row["tf"], row["m"])
        self.value = np.repeat(value, self.end - begin)
        first = np.flatnonzero(np.r_[True, self.term[1:] != self.term[:-1]])
        self.named = self.term[first]
        self.begins, self.ends = begin[first], self.end[np.r_[first[1:], len(self.term)] - 1]

    def best(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best documents from ``least`` on, equal scores by place."""
        at = np.searchsorted(self.named, terms)
        at = at[(at < len(self.named)) & (self.named[np.minimum(at, len(self.named) - 1)] == terms)]
        scores = np.zeros(self.size, np.int64)
        for a, b in zip(self.begins[at].tolist(), self.ends[at].tolist(), strict=True):
            scores[self.docs[a:b]] += self.value[a:b]
        found = np.flatnonzero(scores >= max(least, 1))
        if len(found) > k:
            found = found[np.lexsort((found, -scores[found]))[:k]]
        return found, scores[found]


def _blocks(batch: pa.RecordBatch) -> list[dict]:
    names = batch.schema.names
    out = []
    for i in range(batch.num_rows):
        row = {c: batch.column(names.index(c))[i].as_py() for c in ("block", "m")}
        row |= {c: batch.column(names.index(c))[i].values.to_numpy().astype(np.int64) for c in ("term", "tf", "end", "docs") if c in names}
        if "ids" in names:
            row["ids"] = batch.column(names.index("ids"))[i].values
            row["size"] = len(row["ids"])
        elif "size" in names:
            row["size"] = batch.column(names.index("size"))[i].as_py()
        out.append(row)
    return out


def _answered(index: DataFrame, questions: Questions, k: int, id_type: str) -> DataFrame:
    """(q, score, id): what may be among the k best documents of each question, from one index."""
    sc = index.sparkSession.sparkContext
    asked = sc.broadcast(questions)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of the highest bounds in a task, until they hold k documents."""
        q_all = asked.value
        held: list[list[tuple[int, int, int]]] = [[] for _ in q_all.terms]
        for batch in batches:
            for row in _blocks(batch):
                bounds = q_all.bounds(row["m"], row["term"], row["tf"])
                for q in np.flatnonzero(bounds).tolist():
                    ours = held[q]
                    ours.append((int(bounds[q]), row["block"], row["size"]))
                    if len(ours) > 2 * k:
                        held[q] = _enough(ours, k)
        out = [(q, *x) for q, ours in enumerate(held) for x in _enough(ours, k)]
        columns = zip(*out, strict=True) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["q", "bound", "block", "size"])

    sized = index.select("block", "m", F.size("ids").alias("size"), "term", "tf")
    tops = sized.mapInArrow(highest, "q long, bound long, block long, size long")
    before = Window.partitionBy("q").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    first = tops.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).filter(F.col("before") < k).select("q", "block")
    first, _ = materialize(first.groupBy("block").agg(F.sort_array(F.collect_list("q")).alias("asking")))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_all = asked.value
        for batch in batches:
            asking = batch.column(batch.schema.names.index("asking"))
            for i, row in enumerate(_blocks(batch)):
                block = Block(row, q_all.weights)
                yield from _given([(q, *block.best(q_all.terms[q], k, 1), row["ids"]) for q in asking[i].as_py()])

    # At most k blocks for each of a bounded number of questions.
    opened = index.join(F.broadcast(first), "block").mapInArrow(visit, f"q long, score long, id {id_type}")
    opened, _ = materialize(opened)
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    level = opened.select("q", "score").withColumn("nth", nth).filter(F.col("nth") == k).select("q", "score").toArrow()
    levels = np.ones(len(questions.terms), np.int64)
    levels[level["q"].to_numpy()] = level["score"].to_numpy()
    seen = first.toArrow()
    shared = sc.broadcast((levels, dict(zip(seen["block"].to_pylist(), map(set, seen["asking"].to_pylist()), strict=True))))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All other blocks, for each question in the order of their bounds, down to its threshold."""
        q_all, (start, done) = asked.value, shared.value
        level = start.copy()
        best: list[np.ndarray] = [np.empty(0, np.int64) for _ in q_all.terms]
        step = max(1, BOUNDS // max(1, len(q_all.terms)))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            rows = _blocks(batch)
            bounds = np.stack([q_all.bounds(r["m"], r["term"], r["tf"]) for r in rows])
            blocks: dict[int, Block] = {}
            out = []
            for q in np.flatnonzero((bounds >= level).any(axis=0)).tolist():
                for i in np.argsort(-bounds[:, q], kind="stable").tolist():
                    if bounds[i, q] < level[q]:
                        break
                    if q in done.get(rows[i]["block"], ()):
                        continue
                    block = blocks.get(i) or blocks.setdefault(i, Block(rows[i], q_all.weights))
                    places, scores = block.best(q_all.terms[q], k, int(level[q]))
                    if len(places):
                        out.append((q, places, scores, rows[i]["ids"]))
                        best[q] = np.sort(np.concatenate([best[q], scores]))[-k:]
                        if len(best[q]) == k:
                            level[q] = max(level[q], best[q][0])
            yield from _given(out)

    return opened.unionByName(index.mapInArrow(rest, f"q long, score long, id {id_type}"))


def _enough(blocks: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """The blocks of the highest bounds that together hold k documents."""
    out, n = [], 0
    for x in sorted(blocks, key=lambda x: (-x[0], x[1])):
        if n >= k:
            break
        out.append(x)
        n += x[2]
    return out


def _given(found: list[tuple[int, np.ndarray, np.ndarray, pa.Array]]) -> Iterator[pa.RecordBatch]:
    found = [f for f in found if len(f[1])]
    if found:
        q = pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64())
        ids = pa.concat_arrays([f[3].take(pa.array(f[1])) for f in found])
        yield pa.RecordBatch.from_arrays([q, pa.array(np.concatenate([f[2] for f in found])), ids], ["q", "score", "id"])


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    k: int = TOP,
    group_terms: int = GROUP_TERMS,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """(item id, rank, doc id, score): the k best documents of each item, those with a score above 0.

    The weight of a term held by df of N documents is floor(1000 ln((2N + 2) / (2df + 1))). A
    document of n terms, all documents together having L, has m = 50 + 50nN div L, and scores
    the weight times 10^9 tf div (1000 tf + 20m), summed over the item's different terms.
    Equal scores go by smaller id, null ids last. A null or empty text has no terms; an item
    without terms, or with none that any document holds, has no rows. Rows of ``docs`` repeated under one id are documents of
    their own; items repeated in id and text count once. Other columns play no part; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    asked, seen = materialize(question_terms(items, item_id_col, item_text_col), terms=F.sum(F.size("terms")))
    groups = max(1, math.ceil((seen["terms"] or 0) / group_terms))
    id_type = docs.schema[id_col].dataType.simpleString()
    parts = []
    for group in range(groups):
        table = asked.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == group).toArrow()
        lists = table["terms"].to_pylist()
        names = sorted(set().union(*lists))
        number = {t: i for i, t in enumerate(names)}
        vocabulary = {t.encode("utf-8", "surrogatepass"): i for t, i in number.items()}
        counted, n_docs, n_terms = counted_documents(docs, vocabulary, id_col, text_col)
        df = np.zeros(len(names), np.int64)
        held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df[held["term"].to_numpy()] = held["df"].to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        questions = Questions([[number[t] for t in terms] for terms in lists], weights)
        found = _answered(build_index(counted, n_docs, n_terms, block_docs), questions, k, id_type)
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        items_of = spark.createDataFrame(pa.table({"q": pa.array(range(len(table)), pa.int64()), "item": table["item"]}))
        parts.append(found.join(F.broadcast(items_of), "q").select("item", "rank", "id", "score"))
    item, name = item_id_col, fresh(id_col, [item_id_col, "rank", "score"])
    return reduce(DataFrame.unionByName, parts).toDF(item, "rank", name, "score")
