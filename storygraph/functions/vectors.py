"""Vector columns. Similarities are computed in double and are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A column that a lambda refers to is put into it and computed again for each
    element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """NULL for a zero vector, a NaN component or unequal lengths."""
    return let(F.try_divide(dot(a, b), norm(a) * norm(b)), lambda s: F.when(~F.isnan(s), s))


def unit_vector(counts: Column) -> Column:
    """Scaled to length 1 as array<float>; an all-zero array stays zero."""

    def scaled(c: Column) -> Column:
        return let(norm(c), lambda n: F.transform(c, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)).cast("float")))

    return let(counts, scaled)


def usable(vector: Column) -> Column:
    """A vector that has a direction: present, finite, not all zero."""
    # NaN sorts above infinity, so the upper bound drops it as well.
    return F.coalesce(let(norm(vector), lambda n: (n > 0) & (n < float("inf"))), F.lit(False))
