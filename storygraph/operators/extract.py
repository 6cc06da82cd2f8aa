"""Pages -> listing entries and article records.

Python only picks strings out of each page (``mapInArrow``, column-pruned to URL,
source and HTML). Positions, block precedence, prefixes and dates are columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storygraph.functions.dates import parse_day_month_year, parse_iso, parse_named_month
from storygraph.functions.text import join_text_nodes
from storygraph.functions.urls import absolute_url, resolve_url, strip_quotes, style_url, url_category
from storygraph.operators.markup import Matcher, Matches, Page, compile_selector, read_page
from storygraph.operators.profiles import PROFILES, BlockRule, SiteProfile
from storygraph.schemas import BLOCK
from storygraph.session import materialize

BROADCAST_URLS = 200_000
# Bytes of HTML parsed at a time.
PARSED = 1 << 20

CARD_PICKS = ("link", "title", "image", "image_style")
ELEMENT_PICKS = ("text", "iframe", "image", "caption", "video")
PAGE_PICKS = ("lead_image", "paragraph_image", "date", "gallery")

_STRINGS = pa.list_(pa.string())
_CARDS = pa.list_(pa.struct([(n, _STRINGS) for n in CARD_PICKS] + [("styled", pa.bool_())]))
_ELEMENTS = pa.list_(pa.struct([("tag", pa.string()), ("class", pa.string())] + [(n, _STRINGS) for n in ELEMENT_PICKS]))

_CARD_DDL = "array<struct<" + ", ".join(f"{n}: array<string>" for n in CARD_PICKS) + ", styled: boolean>>"
_ELEMENT_DDL = "array<struct<tag: string, class: string, " + ", ".join(f"{n}: array<string>" for n in ELEMENT_PICKS) + ">>"


def _with_source(pages: DataFrame, profiles: Sequence[SiteProfile]) -> DataFrame:
    """Keep pages of known sites and name the site, by the URL unless the pages have a ``source``."""
    fetched = F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(None).cast("bigint")
    if "source" in pages.columns:
        return pages.select("url", "html", "source", fetched.alias("fetched_at")).filter("source is not null and html is not null")
    source = F.lit(None).cast("string")
    for p in reversed(profiles):
        own = F.lit(False)
        for host in p.hosts:
            own = own | F.col("url").startswith(host)
        source = F.when(own, F.lit(p.source)).otherwise(source)
    named = pages.select("url", "html", source.alias("source"), fetched.alias("fetched_at"))
    return named.filter("source is not null and html is not null")


def _by_source(profiles: Sequence[SiteProfile], make: Callable[[SiteProfile], Column]) -> Column:
    """One expression per site, chosen by the ``source`` column."""
    chosen = None
    for p in profiles:
        hit = F.col("source") == p.source
        chosen = F.when(hit, make(p)) if chosen is None else chosen.when(hit, make(p))
    return chosen


class _Picks:
    """The selectors of a site under their names, compiled into one matcher, and what to take of the elements they match."""

    def __init__(self, specs: dict[str, tuple[str, str] | None], roots: dict[str, str | None]):
        self.what = {n: s[1] for n, s in specs.items() if s is not None}
        texts = {n: s[0] for n, s in specs.items() if s is not None and s[1] != "own texts"} | {n: t for n, t in roots.items() if t}
        self.matcher = Matcher({n: compile_selector(t) for n, t in texts.items()})

    def read(self, html: str) -> Matches:
        return self.matcher.run(read_page(html))

    def take(self, found: Matches, name: str, root: int = 0) -> list[str]:
        what, page = self.what.get(name), found.page
        if what is None:
            return []
        if what == "own texts":
            return page.text[page.text_from[root] : page.text_to[root]] if page.tag else []
        return found.pick(name, what, root)


def in_pieces(batch: pa.RecordBatch, most: int = PARSED) -> Iterator[pa.RecordBatch]:
    """A batch of pages in pieces of about ``most`` bytes of HTML: what is picked out of a page takes several times its room until it is Arrow again."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column("html")).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.flatnonzero(np.r_[True, np.diff(ends // most) > 0]).tolist()
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def shred_listings(pages: DataFrame, profiles: Sequence[SiteProfile]) -> DataFrame:
    """(url, source, fetched_at, cards): the picked strings of every card of a listing page."""
    plans = {p.source: _Picks({n: getattr(p, n) for n in CARD_PICKS}, {"card": p.card}) for p in profiles}

    def cards_of(source: str, html: str) -> list[dict]:
        picks = plans[source]
        found = picks.read(html)
        styled = "image_style" in picks.what
        return [
            {n: picks.take(found, n, root) for n in CARD_PICKS} | {"styled": styled and bool(found.select("image_style", root))}
            for root in found.select("card")
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in in_pieces(whole)):
            sources, html = batch.column("source").to_pylist(), batch.column("html").to_pylist()
            cards = pa.array([cards_of(s, h) for s, h in zip(sources, html)], type=_CARDS)
            kept = [batch.column(n) for n in ("url", "source", "fetched_at")]
            yield pa.RecordBatch.from_arrays([*kept, cards], names=["url", "source", "fetched_at", "cards"])

    return _with_source(pages, profiles).mapInArrow(run, f"url string, source string, fetched_at bigint, cards {_CARD_DDL}")


def shred_articles(pages: DataFrame, profiles: Sequence[SiteProfile]) -> DataFrame:
    """(url, source, elements, page picks): the picked strings of every article page."""
    plans = {
        p.source: _Picks(
            {f"in {n}": p.element_picks.get(n) for n in ELEMENT_PICKS} | {n: getattr(p, n) for n in PAGE_PICKS},
            {"content": p.content, "gallery_root": p.gallery_root},
        )
        for p in profiles
    }

    def class_of(page: Page, root: int) -> str | None:
        """The first class of a div, its own or of one inside it."""
        if page.tag[root] != "div":
            return page.attrs[root].get("class")
        inside = range(root, page.last[root] + 1)
        return next((page.attrs[n]["class"] for n in inside if page.tag[n] == "div" and "class" in page.attrs[n]), None)

    def article_of(source: str, html: str) -> tuple[list[dict], dict]:
        picks = plans[source]
        found = picks.read(html)
        elements = [
            {"tag": found.page.tag[root], "class": class_of(found.page, root)} | {n: picks.take(found, f"in {n}", root) for n in ELEMENT_PICKS}
            for root in found.select("content")
        ]
        taken = {n: picks.take(found, n) for n in PAGE_PICKS}
        if "gallery_root" in found.found:
            first = found.select("gallery_root")[:1]
            taken["gallery"] = picks.take(found, "gallery", first[0]) if first else []
        return elements, taken

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in in_pieces(whole)):
            sources, html = batch.column("source").to_pylist(), batch.column("html").to_pylist()
            found = [article_of(s, h) for s, h in zip(sources, html)]
            arrays = [batch.column("url"), batch.column("source"), pa.array([e for e, _ in found], type=_ELEMENTS)]
            arrays += [pa.array([f[n] for _, f in found], type=_STRINGS) for n in PAGE_PICKS]
            yield pa.RecordBatch.from_arrays(arrays, names=["url", "source", "elements", *PAGE_PICKS])

    ddl = f"url string, source string, elements {_ELEMENT_DDL}, " + ", ".join(f"{n} array<string>" for n in PAGE_PICKS)
    return _with_source(pages, profiles).mapInArrow(run, ddl)


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def extract_listing(pages: DataFrame, profiles: Sequence[SiteProfile] = PROFILES) -> DataFrame:
    """One row per card of each listing page, in document order; cards without link drop out."""
    urls = [u for p in profiles for u in p.listings]
    shredded = shred_listings(pages.filter(F.col("url").isin(urls)), profiles)
    return listing_rows(shredded, profiles)


def listing_rows(shredded: DataFrame, profiles: Sequence[SiteProfile]) -> DataFrame:
    rows = shredded.select("url", "source", "fetched_at", F.posexplode("cards").alias("position", "card"))

    def thumbnail(p: SiteProfile) -> Column:
        value = _first(F.col("card.image"))
        if p.image_style:
            styles = F.array_join("card.image_style", "\n")
            value = F.when(F.col("card.styled"), style_url(styles)).otherwise(value)
        if p.image_prefix:
            value = absolute_url(strip_quotes(_filled(value)), p.image_prefix)
        return value

    def link(p: SiteProfile) -> Column:
        href = _first(F.col("card.link"))
        return absolute_url(href, p.link_prefix, always=True) if p.link_prefix else href

    return rows.select(
        F.col("url").alias("listing_url"),
        "source",
        _by_source(profiles, lambda p: url_category(F.col("url"), p.category_piece)).alias("category"),
        "position",
        _by_source(profiles, link).alias("article_url"),
        _first(F.col("card.title")).alias("title"),
        _by_source(profiles, thumbnail).alias("thumbnail"),
        "fetched_at",
    ).filter("article_url is not null")


def classify_block(e: Column, p: SiteProfile) -> Column:
    """Block of one content element by the first rule that applies, NULL if none does."""
    text = {
        "first": lambda: _first(e["text"]),
        "concat": lambda: F.array_join(e["text"], ""),
        "join": lambda: join_text_nodes(e["text"]),
    }[p.text_mode]()
    values = {n: _first(e[n]) for n in ELEMENT_PICKS if n != "text"} | {"text": text}

    def block(rule: BlockRule) -> Column:
        value = _filled(values[rule.pick]) if rule.required else values[rule.pick]
        none = F.lit(None).cast("string")
        made = F.struct(
            F.lit(rule.type).alias("type"),
            (value if rule.key == "content" else none).alias("content"),
            (values["caption"] if rule.type == "image" and not rule.required else none).alias("content_caption"),
            (value if rule.key == "src" else none).alias("src"),
        )
        applies = e["tag"] == rule.tag
        if rule.class_part:
            applies = applies & F.contains(F.coalesce(e["class"], F.lit("")), F.lit(rule.class_part))
        if rule.required:
            applies = applies & value.isNotNull()
        return F.when(applies, made)

    return F.coalesce(*[block(r) for r in p.rules])


def article_blocks(p: SiteProfile) -> Column:
    """Ordered content: classified elements, then gallery images."""
    kept = F.filter(F.transform("elements", lambda e: classify_block(e, p)), lambda b: b.isNotNull())
    if not p.gallery:
        return kept
    none = F.lit(None).cast("string")
    images = F.transform(
        "gallery",
        lambda g: F.struct(
            F.lit("image").alias("type"),
            resolve_url(F.col("url"), g).alias("content"),
            none.alias("content_caption"),
            none.alias("src"),
        ),
    )
    return F.concat(kept, images)


def article_image(p: SiteProfile) -> Column:
    value = _first(F.col("lead_image"))
    if p.paragraph_image:
        value = F.coalesce(_filled(value), _first(F.col("paragraph_image")))
    return absolute_url(value, p.image_prefix) if p.image_prefix else value


def published_date(p: SiteProfile) -> Column:
    first, second = _first(F.col("date")), F.try_element_at("date", F.lit(2))
    if p.date_form == "iso":
        return parse_iso(first, p.zone)
    if p.date_form == "named_month":
        return parse_named_month(first, p.zone)
    return parse_day_month_year(second, first, p.zone)


def extract_articles(pages: DataFrame, profiles: Sequence[SiteProfile] = PROFILES) -> DataFrame:
    """(url, source, article_image, article_content, article_published_date) of article pages."""
    return shred_articles(pages, profiles).select(
        "url",
        "source",
        _by_source(profiles, article_image).alias("article_image"),
        _by_source(profiles, article_blocks).cast(T.ArrayType(BLOCK)).alias("article_content"),
        _by_source(profiles, published_date).alias("article_published_date"),
    )


def requests(listing: DataFrame) -> DataFrame:
    """Listing entries with the URL their link leads to (``request_url``), resolved against the listing."""
    return listing.withColumn("request_url", resolve_url(F.col("listing_url"), F.col("article_url")))


def newest_pages(pages: DataFrame) -> DataFrame:
    """(url, html) with one page per URL: the newest fetch, in a stable order where fetches tell nothing apart.

    Only a digest of the HTML is sorted and compared; the page itself is taken along for the
    newest key of a task.
    """
    order = [F.col(c) for c in ("fetched_at", "page_id") if c in pages.columns]
    rank = F.struct(*order, F.xxhash64("html"))
    return pages.filter("html is not null").groupBy("url").agg(F.max_by("html", rank).alias("html"))


def requested_records(asked: DataFrame, pages: DataFrame, profiles: Sequence[SiteProfile] = PROFILES, n_asked: int | None = None) -> DataFrame:
    """Article rows of the requests whose page is there: listing metadata joined with what the page holds.

    The site is that of the listing, wherever the page lies. The raw pages meet the wanted URLs
    first, so only those are parsed, once each. Up to ``BROADCAST_URLS`` of them go to the
    pages; beyond that the pages are shuffled. ``n_asked`` is their number where ``asked`` is
    a written table; else they are written here.
    """
    if n_asked is None:
        asked, seen = materialize(asked)
        n_asked = seen["rows"]
    urls = asked.select("source", F.col("request_url").alias("url")).distinct()
    known = urls.select("url").distinct()
    wanted = pages.join(F.broadcast(known) if n_asked <= BROADCAST_URLS else known, "url", "left_semi")
    found = extract_articles(newest_pages(wanted).join(urls, "url"), profiles)
    return asked.join(found.withColumnRenamed("url", "request_url"), ["source", "request_url"]).select(
        "source",
        F.col("title").alias("article_title"),
        "article_url",
        F.col("thumbnail").alias("article_thumbnail"),
        "article_image",
        "article_content",
        "article_published_date",
        F.col("category").alias("article_category"),
        F.lit(None).cast("string").alias("cluster_id"),
    )


def article_records(listing: DataFrame, pages: DataFrame, profiles: Sequence[SiteProfile] = PROFILES) -> DataFrame:
    """The same from listing entries, not yet clustered."""
    return requested_records(requests(listing), pages, profiles)
