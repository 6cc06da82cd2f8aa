"""Text embeddings. A model is any function from a batch of texts to a batch of vectors.

The built-in model hashes word 3-grams into signed buckets. Its counts add up:
the counts of several texts joined by a blank line are the sum of their counts,
so the vector of a cluster text needs neither the text in one place nor the
texts of older members again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storygraph.functions.text import article_text, short_text, truncate_tokens
from storygraph.operators.models import EmbedFn, Tokenizer
from storygraph.params import Params

# Characters of texts whose grams are hashed together, and grams in one go.
GROUP_CHARS, GRAMS = 1 << 20, 16384

# The constants of MD5.
SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
TURNS = np.array([7, 12, 17, 22, 5, 9, 14, 20, 4, 11, 16, 23, 6, 10, 15, 21], np.uint32).reshape(4, 4)
BLOCK, MOST = 64, 55  # bytes of a block, and those a text of one block may have


def ngram_counts(text: str, dim: int) -> np.ndarray:
    """Signed bucket counts of the lower-cased word 3-grams of each blank-line separated passage.

    A passage of fewer than three words counts its single words. Bucket is
    ``h % dim`` and the sign is + where ``h // dim`` is even, ``h`` being the first
    8 hex digits of the MD5 of the gram.
    """
    return next(counts_of([text], dim))


def counts_of(texts: Sequence[str], dim: int) -> Iterator[np.ndarray]:
    """``ngram_counts`` of each text. Texts are taken together up to ``GROUP_CHARS``, as NumPy is fast on many grams only."""
    begin = size = 0
    for k, text in enumerate(texts):
        if size and (size + len(text) > GROUP_CHARS or (k - begin) * dim >= GROUP_CHARS):
            yield from _counted(texts[begin:k], dim)
            begin, size = k, 0
        size += max(len(text), 1)
    if begin < len(texts):
        yield from _counted(texts[begin:], dim)


def _counted(texts: Sequence[str], dim: int) -> np.ndarray:
    passages, words, owner = [], [], []
    for k, text in enumerate(texts):
        for passage in text.lower().split("\n\n"):
            # Blanks are those of ASCII.
            if found := passage.encode().split():
                passages.append(b" ".join(found))
                words.append(len(found))
                owner.append(k)
    data = np.frombuffer(b" ".join([*passages, bytes(BLOCK)]), np.uint8)
    total = np.zeros(len(texts) * dim)
    ends = np.flatnonzero(data == 32)
    n, owner = np.array(words, np.int64), np.array(owner, np.int64)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(ends))  # words up to the end of the passage, this one included
    short = np.repeat(n < 3, n)
    first = np.flatnonzero(short | (left >= 3))
    last = ends[np.where(short[first], first, first + 2)]
    start, of = np.r_[0, ends[:-1] + 1][first] if len(ends) else first, np.repeat(owner, n)[first]
    for s in range(0, len(first), GRAMS):
        part = slice(s, s + GRAMS)
        h = _md5_heads(data, start[part], last[part]).astype(np.int64)
        total += np.bincount(of[part] * dim + h % dim, weights=1 - 2 * ((h // dim) % 2), minlength=len(total))
    return total.astype(np.int64).reshape(len(texts), dim)


def _md5_heads(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first 8 hex digits of the MD5 of each stretch of ``data``, as numbers.

    ``hashlib`` takes a call for each gram, which was most of the time of an embedding; here the
    steps run over many grams at once. Stretches of more than one block are left to it.
    ``data`` goes on for a block at least after the last of them.
    """
    size = end - start
    blocks = np.lib.stride_tricks.sliding_window_view(data, BLOCK)[start]
    blocks[np.arange(BLOCK) >= size[:, None]] = 0
    fits = size <= MOST
    blocks[np.flatnonzero(fits), size[fits]] = 0x80
    m = np.ascontiguousarray(blocks.view("<u4").astype(np.uint32).T)
    m[14] = size * 8
    a, b, c, d = (np.full(len(size), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += SINES[i]
        f += m[g]
        turn = TURNS[i // 16, i % 4]
        a, d, c, b = d, c, b, b + ((f << turn) | (f >> (np.uint32(32) - turn)))
    heads = (a + np.uint32(0x67452301)).byteswap()
    for k in np.flatnonzero(~fits):
        heads[k] = int.from_bytes(hashlib.md5(data[start[k] : end[k]].tobytes()).digest()[:4], "big")
    return heads


def hashed_vectors(dim: int) -> EmbedFn:
    """The built-in model as a batch function."""

    def embed(texts: pd.Series) -> pd.Series:
        def one(found: np.ndarray):
            counts = found.astype(np.float64)
            length = np.linalg.norm(counts)
            return (counts / length if length else counts).astype(np.float32)

        return pd.Series([one(c) for c in counts_of(texts.tolist(), dim)], dtype=object)

    return embed


def embed_text(text: Column, fn: EmbedFn | None = None, params: Params = Params()) -> Column:
    """Vector of a text column by ``fn``, or by the built-in model. NULL texts never reach the model."""
    model = fn or hashed_vectors(params.embed_dim)

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = np.full(len(batch), None, dtype=object)
            given = np.flatnonzero(batch.notna())
            if len(given):
                for at, vector in zip(given, model(batch.iloc[given])):
                    found[at] = vector
            yield pd.Series(found)

    return embed(text)


def cut_text(text: Column, limit: int, tokenizer: Tokenizer | None = None) -> Column:
    """The first ``limit`` tokens of a text, by the tokenizer or as blank-separated words."""
    if tokenizer is None:
        return truncate_tokens(text, limit)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series(list(tokenizer.cut(texts.fillna(""), limit)), dtype=object).where(texts.notna(), None)

    return cut(text)


def embed_articles(
    articles: DataFrame, fn: EmbedFn | None = None, params: Params = Params(), tokenizer: Tokenizer | None = None
) -> DataFrame:
    """Set ``article_embeddings`` from title and paragraphs.

    The built-in model reads whole texts; a model passed in gets the first ``max_tokens`` tokens.
    """
    text = F.col("_text") if fn is None else cut_text(F.col("_text"), params.max_tokens, tokenizer)
    return (
        articles.withColumn("_text", article_text(F.col("article_title"), F.col("article_content")))
        .withColumn("article_embeddings", embed_text(text, fn, params))
        .drop("_text")
    )


def fill_embeddings(articles: DataFrame, fn: EmbedFn | None = None, params: Params = Params()) -> DataFrame:
    """Keep stored embeddings; only rows without one pass the model, with title and summary (or paragraphs)."""
    text = short_text(F.col("article_title"), F.col("article_summary"), F.col("article_content"))
    have = articles.filter(F.col("article_embeddings").isNotNull())
    lack = articles.filter(F.col("article_embeddings").isNull()).withColumn("article_embeddings", embed_text(text, fn, params))
    return have.unionByName(lack)
