"""Column helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
HEX_DIGITS = 13  # of a digest, as many as a double holds exactly


def digest_number(*parts: Column, digits: int = HEX_DIGITS) -> Column:
    """The first hex digits of the MD5 of the parts joined by colons, as an integer. A null part counts as empty."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *text)), 1, digits), 16, 10).cast("long")


def hash_unit(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only."""
    return (digest_number(*parts) + F.lit(0.5)) / F.lit(float(16**HEX_DIGITS))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % folds, F.lit(-1)).cast("int")


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
