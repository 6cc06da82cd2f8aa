"""URL columns: listing category, absolute links, image links in style attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_category(url: Column, piece: int) -> Column:
    """One '/'-separated piece of a URL counted from the end (-1 last, -2 next to last)."""
    return F.split_part(url, F.lit("/"), F.lit(piece))


def absolute_url(url: Column, prefix: str, always: bool = False) -> Column:
    """Put the site in front of a relative link; with ``always`` in front of any link."""
    joined = F.concat(F.lit(prefix), url)
    return joined if always else F.when(url.startswith("http"), url).otherwise(joined)


def resolve_url(base: Column, link: Column) -> Column:
    """The URL that a link on the page ``base`` leads to, as RFC 3986 resolves references.

    Absolute links stay as they are; ``//host``, ``/path``, ``path``, ``?query``, ``#part`` and
    dot segments are resolved; an empty link is the page itself. NULL where either side is NULL.
    """
    link = F.btrim(link)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    whole = F.regexp_extract(base, r"^([^#]*)", 1)
    own = F.regexp_extract(link, r"^([^?#]*)", 1)
    rest = F.substr(link, F.length(own) + 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), link))
        .when(link.startswith("/"), F.concat(site, _without_dots(own), rest))
        .when(link.startswith("?"), F.concat(site, path, link))
        .when(link == "", base)
        .when(link.startswith("#"), F.concat(whole, link))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, own)), rest))
    )


def _without_dots(path: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` segments carried out."""
    pieces = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))

    def step(done: Column, piece: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(piece == "..", up).when(piece == ".", done).otherwise(F.concat(done, F.array(piece)))

    kept = F.aggregate(pieces, F.array().cast("array<string>"), step)
    # A path that ends in a dot segment names a folder.
    end = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def style_url(style: Column) -> Column:
    """First ``url(...)`` of a style attribute; NULL when there is none."""
    return F.nullif(F.regexp_extract(style, r"url\((.*?)\)", 1), F.lit(""))


def strip_quotes(value: Column) -> Column:
    return F.btrim(value, F.lit("'"))


def source_name(name: Column) -> Column:
    return F.lower(F.split_part(name, F.lit("_"), F.lit(1)))
