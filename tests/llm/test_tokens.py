"""Token files: packed blocks, ids of whole texts, order and starts over many files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from storygraph.llm import packing, token_files
from storygraph.llm.token_files import Encoder, file_image, file_rows, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id int, text string, ids long, path string, row int, begin int"


@pytest.mark.parametrize("n", [1, 5, 1024, 5000, 300_000])
@pytest.mark.parametrize("most", [1, 2, 50257, 2**32 - 1])
def test_blocks_round_trip(n, most):
    ids = np.random.default_rng(n).integers(0, most, n, dtype=np.uint64).astype(np.uint32)
    ids[::97] = most
    blocks = packing.encode(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert (packing.decode(b"".join(blocks), starts, n) == ids).all()


def test_rare_large_numbers_are_exceptions():
    ids = np.full(packing.BLOCK, 7, np.uint32) + np.arange(packing.BLOCK, dtype=np.uint32) % 4
    ids[[5, 900]] = 2**31
    block = packing.encode(ids)[0]
    head = np.frombuffer(block, packing.HEAD, 1)[0]
    assert (head["least"], head["width"], head["over"]) == (7, 2, 2)
    assert len(block) == 8 + 2 * packing.BLOCK // 8 + 2 * 6


def test_file_holds_rows_of_any_size():
    rows = [(None, b"\0" * 4), (-5, np.arange(3000, dtype="<u4").tobytes()), (2**60, b"\1\0\0\0")]
    names, named, sizes, ids = file_rows(file_image(rows, 3, 1))
    assert [int(n) if h else None for n, h in zip(names, named, strict=True)] == [i for i, _ in rows]
    assert sizes.tolist() == [1, 3000, 1] and ids.tolist() == [0, *range(3000), 1]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(token_files, "HELD", 50)
    monkeypatch.setattr(token_files, "LONG", 5)
    parts = ["a", "B", " ", "  ", "\n", "é", " don't", "1", "²", "\x1c", "。", "<|endoftext|>", "...", "\t", "\xa0", "́", "'LL"]
    draw = random.Random(3)
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(5000)]
    encoder, whole = Encoder(open(PATH).read()), Tokenizer.from_file(PATH)
    got = [encoder.encode(t) for t in texts]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_files_equal_brute_force(spark):
    rows = [(i * 7 % 101, f"text number {i} of them " * (i % 5)) for i in range(101)]
    rows += [(None, "no id"), (200, None), (201, ""), (50, "x"), (50, "x"), (50, "y"), (-3, "first"), (300, "long word " * 20000), (301, "z" * 50000)]
    docs = spark.createDataFrame([(*r, 1, "p", 2, 3) for r in rows], SCHEMA).repartition(5)
    found = read_token_files(spark, write_token_files(docs, PATH, file_ids=300)).collect()
    tokenizer = Tokenizer.from_file(PATH)

    def ids(text):
        return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()

    assert sorted((r.doc_id if r.doc_id is not None else -99, bytes(r.ids)) for r in found) == sorted((i if i is not None else -99, ids(t)) for i, t in rows)
    found.sort(key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in found:
        assert (r.start, r.n_tokens * 4) == (at, len(r.ids))
        at += r.n_tokens
    assert zlib.crc32(ids(None)) == zlib.crc32(b"\0\0\0\0")


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert read_token_files(spark, write_token_files(docs, PATH)).collect() == []
