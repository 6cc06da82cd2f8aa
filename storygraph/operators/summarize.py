"""Article and cluster summaries with a pluggable model and an extractive default."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storygraph.functions.text import paragraphs, strip, token_count, tokens
from storygraph.functions.vectors import let
from storygraph.operators.models import SummaryFn, Tokenizer
from storygraph.params import Params

LEAD_SENTENCES = 3
SENTENCE = r"([^.!?]+[.!?]*)"
SUMMARY_DDL = "cluster_title string, cluster_content string"


def lead_sentences(text: Column, n: int = LEAD_SENTENCES) -> Column:
    """The first sentences of a text, the built-in summary."""
    sentences = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(1))
    return F.nullif(strip(F.array_join(F.slice(sentences, 1, n), "")), F.lit(""))


def key_order(sentence: Column) -> Column:
    """Sorts sentences by what they tell: different words less repeated ones, most first; equals by their text."""
    place = let(tokens(sentence), lambda words: F.size(words) - 2 * F.size(F.array_distinct(words)))
    return F.struct(place.alias("place"), sentence.alias("sentence"))


def best_sentences(sentences: Column, n: int) -> Column:
    """The ``n`` different sentences of an array that come first by ``key_order``.

    The best of several arrays are the best of their own best ones, so they can be merged.
    """
    ranked = F.slice(F.sort_array(F.transform(F.array_distinct(sentences), key_order)), 1, n)
    return F.transform(ranked, lambda r: r["sentence"])


def sentences_of(text: Column) -> Column:
    """All sentences of a text, without those of white space alone."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(1)), strip), lambda s: s != "")


def summarize_text(text: Column, fn: SummaryFn | None = None) -> Column:
    """Summary by ``fn`` or by lead sentences. NULL texts never reach ``fn``.

    ``fn`` gets whole batches. Where one fails, its rows are tried one by one, and a row that
    fails by itself gets NULL.
    """
    if fn is None:
        return lead_sentences(text)

    def attempt(given: pd.Series) -> list[str | None]:
        try:
            found = list(fn(given))
            if len(found) != len(given):
                raise ValueError(f"{len(found)} summaries of {len(given)} texts")
            return found
        except Exception:
            if len(given) == 1:
                return [None]
            return [one for i in range(len(given)) for one in attempt(given.iloc[i : i + 1])]

    @F.pandas_udf("string")
    def summarize(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            given = batch[batch.notna()]
            found = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if len(given):
                found[given.index] = attempt(given)
            yield found

    return summarize(text)


def tokens_in(text: Column, tokenizer: Tokenizer | None = None) -> Column:
    """Number of tokens, by the tokenizer or as blank-separated words."""
    if tokenizer is None:
        return token_count(text)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(list(tokenizer.count(texts.fillna(""))), dtype="int32")

    return count(text)


def summarize_articles(
    articles: DataFrame, fn: SummaryFn | None = None, params: Params = Params(), tokenizer: Tokenizer | None = None
) -> DataFrame:
    """Set ``article_summary`` for articles of more than ``summary_min_tokens`` tokens.

    Short articles never reach the model.
    """
    body = articles.withColumn("_body", paragraphs(F.col("article_content")))
    # Hand NULL to the model instead of the text: WHEN alone would still evaluate a Python column.
    gated = F.when(tokens_in(F.col("_body"), tokenizer) > params.summary_min_tokens, F.col("_body"))
    summary = F.nullif(summarize_text(gated, fn), F.lit(""))
    return body.withColumn("article_summary", summary).drop("_body")


def parse_summary(json_text: Column) -> Column:
    """JSON object of a cluster summary -> struct; NULL fields where it is malformed."""
    return F.from_json(json_text, SUMMARY_DDL)
