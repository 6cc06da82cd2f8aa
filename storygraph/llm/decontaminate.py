"""Benchmark decontamination: item-sized windows of documents, found by SimHash and verified.

1. Anchors: shingles of a document that some benchmark item holds. A window as similar to an
   item as asked holds at least ``need`` of them, so all other windows are left out without
   loss, and with them all documents that share next to nothing with the benchmark.
2. Every window left has the size of the items it is held against, and a SimHash.
3. Fingerprints are cut into blocks. Of two within ``radius`` bits, some block differs in at
   most radius / blocks bits, so an index of each item's blocks with these bits turned finds
   all items within the radius of a window, and bit distances leave exactly those.
4. Candidates are verified: the weighted Jaccard similarity of their shingles, each weighted by
   how often it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storygraph.llm.columns import fresh
from storygraph.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19  # unrelated texts differ in 32 of 64 bits; windows at the threshold in about 10
BLOCKS = 10
LANES = 22  # counters of three bits share a long, 21 binary digits each
BROADCAST_ROWS = 1_000_000


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of the word shingles of a text in order; fewer words are one shingle, none is an empty array.

    Words are runs of letters and digits, in lower case.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)]))
        few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) >= shingle, many).otherwise(few)

    # The words are bound once: an expression used in several places is computed in each.
    return F.element_at(F.transform(F.array(words), hashes), 1)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a written table that was counted small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(df[id_col], df[text_col])


def _simhash(hashes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp) from rows of (keys, h): bit i is set if it is in over half of the h."""
    h = F.col("h")

    def bit(i: int) -> Column:
        return F.shiftrightunsigned(h, i).bitwiseAND(F.lit(1).cast("long"))

    def lanes(k: int) -> Column:
        total = bit(k)
        for place, i in ((21, k + LANES), (42, k + 2 * LANES)):
            if i < 64:
                total = total + F.shiftleft(bit(i), place)
        return F.sum(total).alias(f"c{k}")

    counted = hashes.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), *[lanes(k) for k in range(LANES)])
    fp = F.lit(0).cast("long")
    for i in range(64):
        count = F.shiftright(F.col(f"c{i % LANES}"), 21 * (i // LANES)).bitwiseAND(F.lit((1 << 21) - 1).cast("long"))
        fp = fp.bitwiseOR(F.when(count * 2 > F.col("size"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, "size", fp.alias("fp"))


def _blocks(radius: int, blocks: int) -> list[tuple[int, int]]:
    width, wide = divmod(64, blocks)
    out, at = [], 0
    for i in range(blocks):
        out.append((at, width + (i < wide)))
        at += out[-1][1]
    return out


def _block(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def block_keys(fp: Column, radius: int = RADIUS, blocks: int = BLOCKS, turned: bool = False) -> Column:
    """(block, value) keys of a fingerprint; with ``turned`` also the values with up to radius // blocks bits turned."""
    keys = []
    for b, (at, width) in enumerate(_blocks(radius, blocks)):
        value = _block(fp, at, width)
        masks = {0}
        for _ in range(radius // blocks if turned else 0):
            masks |= {m ^ (1 << i) for m in masks for i in range(width)}
        keys += [F.struct(F.lit(b).alias("block"), value.bitwiseXOR(F.lit(m).cast("long")).alias("value")) for m in sorted(masks)]
    return F.array(*keys)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """(row_key, id, item, similarity, start, shingles) of each document and each item it holds.

    ``start`` counts words from 0 and names the most similar window, the first of equal ones.
    A document shorter than an item is one window. Texts of fewer than five words are one
    shingle, so such an item is found only as a whole document. Null and empty texts match
    nothing. Rows that agree in id and text are reported once; different texts under one id
    are reported each, by row_key. Rows without a leak do not appear. Items are never
    collected: their shingles are broadcast while counted small and joined otherwise.
    """
    share = 2 * similarity / (1 + similarity)
    items = benchmark.select(benchmark[item_col].alias("item"), shingle_hashes(benchmark[item_text_col]).alias("hashes")).filter(F.size("hashes") > 0)
    items = items.select("item", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    items, n_items = materialize(items.groupBy("item", "n", "h").agg(F.count(F.lit(1)).alias("times")))
    known, n_known = materialize(items.select("h", "n").distinct())

    rows = docs.select(_row_key(docs, id_col, text_col).alias("row_key"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    placed = rows.select("row_key", F.posexplode(shingle_hashes(F.col("text"))).alias("pos", "h"))
    # A distinct position per size of item; rows repeated as a whole fall together here.
    anchors = placed.join(_small(known, n_known["rows"]), "h").select("row_key", "n", "pos").distinct()
    starts = F.sequence(F.greatest(F.col("pos") - F.col("n") + 1, F.lit(0)), F.col("pos"))
    windows = anchors.select("row_key", "n", F.explode(starts).alias("start")).groupBy("row_key", "n", "start").agg(F.count(F.lit(1)).alias("hits"))
    # Of windows shorter than the item at the end of a document only whole documents count; see below.
    windows, n_windows = materialize(windows.filter((F.col("hits") >= F.ceil(F.col("n") * share - 1e-9)) | (F.col("start") == 0)))

    held, n_held = materialize(windows.select("row_key").distinct())
    found = rows.join(_small(held, n_held["rows"]), "row_key", "left_semi").select("row_key", "id", shingle_hashes(F.col("text")).alias("hashes"))
    found, _ = materialize(found.dropDuplicates(["row_key"]))
    length = F.least(F.col("n"), F.size("hashes"))
    whole = (F.col("start") + F.col("n") <= F.size("hashes")) | (F.col("start") == 0)
    need = F.ceil((F.col("n") + length) * (similarity / (1 + similarity)) - 1e-9)
    cut = windows.join(found, "row_key").filter(whole & (F.col("hits") >= need))
    shingles = cut.select("row_key", "n", "start", F.explode(F.slice("hashes", F.col("start") + 1, length)).alias("h"))
    shingles, _ = materialize(shingles)

    keys = ["row_key", "n", "start"]
    prints = _simhash(shingles, keys)
    spread = items.select("item", "n", F.explode(F.array_repeat("h", F.col("times").cast("int"))).alias("h"))
    item_prints = _simhash(spread, ["item", "n"])
    index = item_prints.select("item", "n", F.col("fp").alias("item_fp"), F.explode(block_keys(F.col("fp"), radius, blocks, turned=True)).alias("key"))
    asked = prints.select(*keys, "size", "fp", F.explode(block_keys(F.col("fp"), radius, blocks)).alias("key"))
    near = asked.join(index, ["n", "key"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    pairs = near.select(*keys, "size", "item").distinct()

    times = shingles.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("in_window"))
    common = pairs.join(times, keys).join(items.select("item", "h", "times"), ["item", "h"])
    shared = common.groupBy(*keys, "size", "item").agg(F.sum(F.least("in_window", "times")).alias("shared"))
    alike = F.col("shared") / (F.col("size") + F.col("n") - F.col("shared"))
    good = shared.select("row_key", "item", "start", "size", alike.alias("similarity")).filter(F.col("similarity") >= similarity)
    best = good.groupBy("row_key", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), "size")).alias("b"))
    named = best.join(found.select("row_key", "id"), "row_key")
    return named.select("row_key", F.col("id").alias(id_col), F.col("item").alias(item_col), "b.similarity", (-F.col("b.start")).alias("start"), F.col("b.size").alias("shingles"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, columns unchanged."""
    bad, seen = materialize(leaks(docs, benchmark, id_col, text_col, **options).select("row_key").distinct())
    key = fresh("row_key", docs.columns)
    keyed = docs.withColumn(key, _row_key(docs, id_col, text_col))
    return keyed.join(_small(bad.withColumnRenamed("row_key", key), seen["rows"]), key, "left_anti").select(*docs.columns)
