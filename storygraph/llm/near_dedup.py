"""Near duplicates by SimHash: Golay-code fuzzy keys, verified bit distances, connected groups.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits. With at most four
differing bits, either some segment is equal and another differs in at most two bits, or two
segments differ in exactly one bit each. Both cases meet under keys made of Golay codeword
indices: words at distance 1 share the nearest codeword of either among those within
distance 4 of the other, words at distance 2 share some codeword within distance 4 of both.
So the keys lose no link, and every link is verified by its bit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storygraph.llm import golay
from storygraph.llm.columns import fresh
from storygraph.operators.components import connected_components
from storygraph.session import materialize

SEED = 42
MAX_DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
ORDERED = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
SMALL_GROUP = 48  # groups up to so many fingerprints compare all pairs at once, larger ones grow a forest
LARGE_GROUP = 20_000  # larger groups are cut into blocks that meet pairwise
BROADCAST_KEYS = 300_000  # rows to drop whose keys are broadcast
LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of a text: XXH64 of the shingles of its ASCII-lower-cased words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words) - shingle + 1
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype=np.uint64)
    # Eight counters of one byte in each word, emptied before they can overflow.
    cuts = np.arange(0, n, 255)
    counts = np.empty((8, 8), dtype=np.int64)
    for bit in range(8):
        lanes = np.add.reduceat(h >> np.uint64(bit) & LANES, cuts)
        counts[:, bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a signed long. No shuffle."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.md5(F.coalesce(docs[text_col], F.lit(""))).alias("digest"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp.view(np.int64))], ["id", "digest", "fp"])

    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, digest string, fp long")


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows of distinct fingerprints. The lowest bit of a key is 0 for a
    fingerprint that asks with its own nearest codewords, 1 for one that answers; the rest names the group."""
    parts = [(fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    centres = [golay.centre(p) for p in parts]
    near = [golay.near(p) for p in parts]
    keys, owners = [], []

    def add(tag: int, body: np.ndarray, valid: np.ndarray, role: int) -> None:
        owner = np.broadcast_to(fp.reshape(-1, *[1] * (body.ndim - 1)), body.shape)
        keys.append(((np.int64(tag) << 35 | body) << 1 | role)[valid])
        owners.append(owner[valid])

    for tag, (a, b) in enumerate(PAIRS):
        asked = centres[a] << 12 | centres[b]
        add(tag, asked, np.ones(asked.shape, bool), 0)
        valid = (near[a] >= 0)[:, :, None] & (near[b] >= 0)[:, None, :]
        add(tag, near[a][:, :, None] << 12 | near[b][:, None, :], valid, 1)
    for tag, (a, b) in enumerate(ORDERED, start=len(PAIRS)):
        add(tag, parts[a][:, None] << 12 | near[b], near[b] >= 0, 1)
    return np.concatenate(keys), np.concatenate(owners)


def _forest(fp: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the groups of distinct fingerprints: at most one for each of them."""
    out = []
    rest = fp
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            close = np.bitwise_count(rest ^ u) <= distance
            if close.any():
                found = rest[close]
                rest = rest[~close]
                out.append((np.full(len(found), u), found))
                queue.extend(found)
    return out


def _links(keys: np.ndarray, fp: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Verified links of whole groups; rows are sorted by key."""
    group = keys >> 1
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    out = []
    for at in np.flatnonzero(sizes > SMALL_GROUP):
        part = slice(starts[at], starts[at] + sizes[at])
        if group[starts[at]] >> 35 >= len(PAIRS) or not keys[starts[at]] & 1:  # else nobody asks
            out += _forest(np.unique(fp[part]), distance)
    small = np.repeat((sizes > 1) & (sizes <= SMALL_GROUP), sizes)
    group, role, fp = group[small], keys[small] & 1, fp[small]
    symmetric = group >> 35 >= len(PAIRS)
    for step in range(1, SMALL_GROUP):
        if len(group) <= step:
            break
        same = group[step:] == group[:-step]
        if not same.any():
            break
        i = np.flatnonzero(same & ((role[step:] != role[:-step]) | symmetric[step:]))
        a, b = fp[i], fp[i + step]
        bits = np.bitwise_count(a ^ b)
        good = (bits <= distance) & (bits > 0)
        out.append((a[good], b[good]))
    return out


def _edges(links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not links:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    u, v = (np.concatenate(x) for x in zip(*links, strict=True))
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _batch(u: np.ndarray, v: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    """Links, or with a key rows that belong to a group too large for one task."""
    keys = pa.nulls(len(u), pa.int64()) if key is None else pa.array(key)
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), keys], ["u", "v", "key"])


def link_fingerprints(fps: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(u, v) links that connect all of the distinct fingerprints ``fp`` within ``distance`` bits.

    Each is a true link; together they join whatever any links join, without all pairs of a
    dense group. Rows are dealt by key and read in order, so a task holds one group at a
    time. A group of more than ``LARGE_GROUP`` rows is put out as it is and cut into blocks.
    """
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"the keys hold for distances of 0 to {MAX_DISTANCE}")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, f = fuzzy_keys(batch.column(0).to_numpy().view(np.uint64))
            for at in range(0, len(k), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(k[at : at + (1 << 18)]), pa.array(f[at : at + (1 << 18)].view(np.int64))], ["key", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, over = 0, None

        def flush(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            u, v = _edges(_links(k, f, distance))
            if len(u):
                yield _batch(u, v)

        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if over is not None:
                cut = int(np.searchsorted(k >> 1, over, side="right"))
                if cut:
                    yield _batch(f[:cut], f[:cut], k[:cut] >> 1)
                k, f = k[cut:], f[cut:]
                if not len(k):
                    continue
                over = None
            held.append((k, f))
            n += len(k)
            if n < LARGE_GROUP:
                continue
            k, f = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(k >> 1, k[-1] >> 1))
            if last:
                yield from flush(k[:last], f[:last])
                k, f = k[last:], f[last:]
            if len(k) > LARGE_GROUP:
                over = k[-1] >> 1
                yield _batch(f, f, k >> 1)
                k, f = k[:0], f[:0]
            held, n = [(k, f)], len(k)
        if n:
            yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    # Each fingerprint becomes 119 keys, so the few bytes of them are dealt to all tasks first.
    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = fps.select("fp").distinct().repartition(width, "fp")
    keys = distinct.mapInArrow(keyed, "key long, fp long")
    dealt = keys.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    found, seen = materialize(dealt.mapInArrow(linked, "u long, v long, key long"), over=F.count("key"))
    links = found.filter("key IS NULL").select("u", "v")
    if seen["over"]:
        links = links.unionByName(_blocked(found.filter("key IS NOT NULL").select("key", F.col("u").alias("fp")), distance))
    return links.distinct()


def _blocked(rows: DataFrame, distance: int) -> DataFrame:
    """Links of the large groups: blocks of a bounded size, each pair of blocks in one task."""
    rows = rows.distinct()
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / LARGE_GROUP).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.join(sizes, "key").withColumn("mine", mine).withColumn("other", other)
    dealt = dealt.select("key", "fp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def spanned(table: pa.Table) -> pa.Table:
        u, v = _edges(_forest(np.unique(table["fp"].to_numpy().view(np.uint64)), distance))
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return dealt.groupBy("key", "i", "j").applyInArrow(spanned, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, fp, digest, component_id, kept) for every row of ``docs``.

    Rows whose fingerprints are linked, directly or through others, share component_id: the
    smallest id among them (nulls count only where there is nothing else). ``kept`` marks
    the row of that id, by the smallest text digest where ids repeat. A null or empty text
    has fingerprint 0 and is linked like any other. Repeated rows are marked alike. Columns
    besides id and text play no part; an empty table gives an empty result.
    """
    rows, _ = materialize(fingerprints(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("digest"))).alias("first")
    firsts = rows.groupBy("fp").agg(first)
    nodes = connected_components(link_fingerprints(rows, distance), "u", "v")
    grouped = firsts.join(nodes, firsts["fp"] == nodes["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    grouped, _ = materialize(grouped)
    best = grouped.groupBy("component").agg(F.min("first").alias("best"))
    answers = grouped.select("fp", "component").join(best, "component").select("fp", F.col("best.id").alias("component_id"), F.col("best.digest").alias("best_digest"))
    out = rows.join(answers, "fp")
    kept = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("best_digest"))
    return out.select(F.col("id").alias(id_col), "fp", "digest", "component_id", kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, columns unchanged.

    The keys of the rows to drop are broadcast while they are counted few, so texts are not
    shuffled; beyond that the rows meet them in a join. Rows equal in id and text are one.
    """
    marked = near_duplicates(docs, id_col, text_col, **options)
    counted = marked.groupBy(F.col(id_col).alias("_its_id"), F.col("digest").alias("_its_digest")).agg(F.count(F.lit(1)).alias("n"), F.first("kept").alias("kept"))
    keys, seen = materialize(counted, most=F.max(F.when(F.col("kept"), F.col("n"))), dropped=F.count_if(~F.col("kept")))
    dropped = keys.filter("not kept").select("_its_id", "_its_digest")
    if seen["dropped"] <= BROADCAST_KEYS:
        dropped = F.broadcast(dropped)
    digest = fresh("_digest", docs.columns)
    keyed = docs.withColumn(digest, F.md5(F.coalesce(docs[text_col], F.lit(""))))
    left = keyed.join(dropped, keyed[id_col].eqNullSafe(dropped["_its_id"]) & (keyed[digest] == dropped["_its_digest"]), "left_anti")
    if (seen["most"] or 0) > 1:
        left = left.dropDuplicates([id_col, digest])
    return left.select(*docs.columns)
