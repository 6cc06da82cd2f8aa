"""Article texts: paragraphs, embedding texts, word counts, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Cut white space of any script off both ends, no-break blanks included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def paragraphs(content: Column) -> Column:
    """Paragraph blocks of an article joined by one blank."""
    kept = F.filter(content, lambda b: b["type"] == "paragraph")
    return F.array_join(F.transform(kept, lambda b: b["content"]), " ")


def article_text(title: Column, content: Column) -> Column:
    """Title and paragraphs. NULL without a title: such an article is rejected, not embedded."""
    return F.concat(title, F.lit(" "), paragraphs(content))


def short_text(title: Column, summary: Column, content: Column) -> Column:
    """Title and summary, or title and paragraphs where there is no summary."""
    return strip(F.concat(title, F.lit(" "), F.coalesce(summary, paragraphs(content))))


def refresh_text(title: Column, summary: Column) -> Column:
    """Title and summary; a missing summary counts as empty."""
    return strip(F.concat(title, F.lit(" "), F.coalesce(summary, F.lit(""))))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


def token_count(text: Column) -> Column:
    """Words of a text, the default tokenizer."""
    return F.regexp_count(text, F.lit(r"\S+"))


def truncate_tokens(text: Column, limit: int) -> Column:
    """The first ``limit`` words; a text within the limit stays as it is."""
    cut = F.array_join(F.slice(tokens(text), 1, limit), " ")
    return F.when(token_count(text) > limit, cut).otherwise(text)


def join_text_nodes(nodes: Column) -> Column:
    """Strip each text node, drop the empty ones, join by one blank."""
    return F.array_join(F.filter(F.transform(nodes, strip), lambda t: t != ""), " ")
