"""Token ids of whole documents in binary files of patched frame-of-reference blocks.

Documents are dealt by ranges of their id and sorted within them, so the files in the order of
(task, number) hold the documents in ascending order. A file is one row of a plain binary
write: Spark's own writer commits it, on whatever storage the path names, and a lost task
writes it again. Its parts, all little-endian:

    magic, docs (u64), ids (u64), task (u32), number (u32)
    per document: id (i64), whether it has one (u8), number of token ids (u64)
    per block: where it begins, counted from the first one (u64)
    the blocks (see ``packing``), an end of line
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storygraph.llm import packing
from storygraph.session import scratch_path

HEADER = "<8sQQII"
MAGIC = b"ids-pfr1"
FILE_IDS = 1 << 22  # a file is closed with the document that reaches so many ids
BATCH_IDS = 1 << 20  # ids given out together when files are read, more only for one long document
BROADCAST_FILES = 200_000
HELD = 800_000  # pieces that a worker remembers
LONG = 256  # longer ones are not remembered
CUT = re.compile(r"(?<=\S)(?= )")

# How byte-level vocabularies cut a text before merging, here for the letters of
# Latin-1, whose classes are the same in every version of Unicode.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
LATIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")

# The characters that spell the 256 bytes in such a vocabulary; printable ones of
# Latin-1 stand for themselves, the others in turn for those from 256 on.
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
SPELLED = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in PRINTED)}


def separable(config: str) -> bool:
    """Whether ids of a text are those of its pieces: byte-level, without normaliser, prefix blank or added tokens that take blanks."""
    conf = json.loads(config)
    pre = conf.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]) for t in conf.get("added_tokens") or [])
    alone = conf.get("normalizer") is None and conf.get("truncation") is None and not (conf.get("model") or {}).get("dropout")
    bpe = (conf.get("model") or {}).get("type") == "BPE" and not (conf.get("model") or {}).get("ignore_merges")
    return alone and plain and bpe and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers; pieces of texts are encoded once and remembered, up to a bound.

    A text of Latin letters is cut as the pre-tokenizer cuts it, any other one before blanks
    that follow a character, over which no piece of a pre-tokenizer goes on. A text with an
    added token, and every text of a vocabulary of another kind, is encoded whole.
    """

    def __init__(self, config: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.separable = separable(config)
        self.added = [t["content"] for t in json.loads(config).get("added_tokens") or []]
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return _numbers(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _merged(self, piece: str) -> bytes:
        """Ids of one piece of the pre-tokenizer: bytes spelled as the vocabulary spells them, then merged."""
        spelled = piece.encode().decode("latin-1").translate(SPELLED)
        return _numbers([t.id for t in self.tokenizer.model.tokenize(spelled)])

    def _pieces(self, text: str) -> tuple[list[str], bool]:
        """Pieces that can be encoded apart, and whether they are those of the pre-tokenizer."""
        if not self.separable or any(t in text for t in self.added):
            return [text], False
        return (PIECE.findall(text), True) if LATIN.fullmatch(text) else (CUT.split(text), False)

    def encode(self, text: str) -> bytes:
        known = self.known
        pieces, final = self._pieces(text)
        if not self.separable or len(pieces) == 1 and not final:
            return self._whole(text)
        found = list(map(known.get, pieces))
        if None in found:
            make = self._merged if final else self._whole
            for i, body in enumerate(found):
                if body is None:
                    piece = pieces[i]
                    # It may have come up earlier in this text.
                    found[i] = known.get(piece) or make(piece)
                    if len(piece) <= LONG:
                        known[piece] = found[i]
            if len(known) > HELD:
                known.clear()
        return b"".join(found)


def _numbers(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()


@lru_cache(maxsize=1)
def encoder_of(config: str) -> Encoder:
    """One encoder per worker, which keeps its pieces from task to task."""
    return Encoder(config)


def file_image(rows: list[tuple[int | None, bytes]], task: int, number: int) -> bytes:
    """One file of (document id, ids) rows."""
    ids = np.frombuffer(b"".join(b for _, b in rows), "<u4")
    blocks = packing.encode(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    parts = [
        struct.pack(HEADER, MAGIC, len(rows), len(ids), task, number),
        np.array([0 if i is None else i for i, _ in rows], "<i8").tobytes(),
        np.array([i is not None for i, _ in rows], np.uint8).tobytes(),
        np.array([len(b) // 4 for _, b in rows], "<u8").tobytes(),
        starts.astype("<u8").tobytes(),
    ]
    return b"".join([*parts, *blocks, b"\n"])


def file_rows(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, whether each has one, numbers of ids, ids) of a file."""
    magic, docs, n, _, _ = struct.unpack_from(HEADER, image)
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    at = struct.calcsize(HEADER)
    names = np.frombuffer(image, "<i8", docs, at)
    named = np.frombuffer(image, np.uint8, docs, at := at + 8 * docs)
    sizes = np.frombuffer(image, "<u8", docs, at := at + docs)
    blocks = -(-n // packing.BLOCK)
    starts = np.frombuffer(image, "<u8", blocks, at := at + 8 * docs)
    return names, named.astype(bool), sizes.astype(np.int64), packing.decode(memoryview(image)[at + 8 * blocks :], starts, n)


def write_token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0, file_ids: int = FILE_IDS, path: str | None = None) -> str:
    """Write the ids of all texts, each followed by ``end``, in ascending order of the id; gives the folder.

    ``tokenizer`` is the path of a file of the tokenizers library, read where the driver runs.
    A null text counts as empty and is its end alone. A null id comes first; rows of equal id
    are all written, ordered by a hash of the text. A document is never divided; one longer
    than ``file_ids`` has a file of its own size. Other columns play no part; an empty table
    gives a folder without documents. Ids are integers.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        config = spark.sparkContext.broadcast(file.read())
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("row"))
    # Hash and row number deal out the rows of one id, however many there are.
    order = [F.col("id").asc_nulls_first(), F.col("digest"), F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    stop = np.array([end], "<u4").tobytes()

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, number = encoder_of(config.value), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                body = encoder.encode(text.as_py())
                held.append((name.as_py(), body + stop))
                size += len(body) // 4 + 1
                if size >= file_ids:
                    yield _image(held, task, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield _image(held, task, number)

    path = path or scratch_path(spark)
    made = dealt.mapInArrow(images, "image binary")
    made.select(F.col("image").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    return path


def _image(rows: list[tuple[int | None, bytes]], task: int, number: int) -> pa.RecordBatch:
    # The writer adds the end of line.
    return pa.RecordBatch.from_arrays([pa.array([file_image(rows, task, number)[:-1]], pa.binary())], ["image"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents in a folder of token files.

    ``start`` counts the ids of all documents before, ``ids`` are little-endian unsigned
    32-bit numbers, the end id included. The order of files comes from one row per file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [struct.unpack_from(HEADER, b) for b in batch.column(1).to_pylist()]
            columns: Iterable = zip(*found, strict=True) if found else [()] * 5
            _, _, n, task, number = columns
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (task, number, n))], ["path", "task", "number", "n"])

    short = files.select("path", F.substring("content", 1, struct.calcsize(HEADER)).alias("content"))
    listed = short.mapInArrow(heads, "path string, task long, number long, n long")
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = listed.groupBy("task").agg(F.sum("n").alias("n")).select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    begins = listed.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(tasks, "task")
    begins = begins.select("path", (F.col("before") + F.col("inside")).alias("begin"))
    few = files.select("path").limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    placed = files.join(F.broadcast(begins) if few else begins, "path").select("begin", "content")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, named, sizes, ids = file_rows(image.as_py())
                ends = np.cumsum(sizes)
                offsets = np.concatenate([[0], ends * 4])
                a = 0
                while a < len(names):
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + BATCH_IDS)))
                    body = ids[(ends[a] - sizes[a]) : ends[b - 1]].astype("<u4").tobytes()
                    each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((offsets[a : b + 1] - offsets[a]).astype(np.int64)), pa.py_buffer(body)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[a:b], mask=~named[a:b]), pa.array(begin + ends[a:b] - sizes[a:b]), pa.array(sizes[a:b]), each.cast(pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    a = b

    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
