"""What differs between news sites, as data: selectors, block rules, prefixes, date forms."""

from __future__ import annotations

from dataclasses import dataclass, field

from storygraph.functions.dates import SITE_ZONE

Pick = tuple[str, str]  # selector and what to take, see ``markup.pick``


@dataclass(frozen=True)
class BlockRule:
    """An element of this tag (and class part) becomes a block of ``type`` from one pick."""

    tag: str
    pick: str
    type: str
    class_part: str | None = None
    key: str = "content"
    required: bool = True  # an empty pick makes no block


@dataclass(frozen=True)
class SiteProfile:
    source: str
    hosts: tuple[str, ...]
    listings: tuple[str, ...]
    category_piece: int
    card: str
    link: Pick
    title: Pick
    content: str
    rules: tuple[BlockRule, ...]
    text_mode: str  # "first", "concat" or "join"
    lead_image: Pick
    date: Pick
    date_form: str  # "iso", "named_month" or "time_date"
    image: Pick | None = None
    image_style: Pick | None = None
    paragraph_image: Pick | None = None
    gallery: Pick | None = None
    gallery_root: str | None = None  # the gallery is read within the first of these
    link_prefix: str | None = None  # put in front of every link
    image_prefix: str | None = None  # put in front of relative images
    zone: str = SITE_ZONE
    element_picks: dict[str, Pick] = field(
        default_factory=lambda: {
            "text": ("*", "own texts"),
            "iframe": ("iframe", "@src"),
            "image": ("img", "@src"),
            "caption": ("figcaption", "text"),
            "video": ("video source", "@src"),
        }
    )


# The three sites.
LAPSI = SiteProfile(
    source="lapsi",
    hosts=("https://lapsi.al/",),
    listings=("https://lapsi.al/kategoria/te-fundit/",),
    category_piece=-2,
    card="div#content article",
    link=("div.post-content-wrapper a, div.post-content-wrapper a *", "@href"),
    title=("div.post-content-wrapper a", "texts"),
    image=("img", "@src"),
    content="div.entry-content > *",
    rules=(
        BlockRule("p", "iframe", "iframe"),
        BlockRule("p", "text", "paragraph"),
        BlockRule("image", "image", "image", required=False),
        BlockRule("div", "video", "video", class_part="wp-video", required=False),
    ),
    text_mode="concat",
    lead_image=("div.post-preview img", "@src"),
    date=("div.entry-meta time.published", "@datetime"),
    date_form="iso",
)

PAMFLETI = SiteProfile(
    source="pamfleti",
    hosts=("https://pamfleti.net/",),
    listings=("https://pamfleti.net/category/aktualitet/",),
    category_piece=-2,
    card="div.c-flexy.shtoketu article.a-card",
    link=("a", "@href"),
    title=("h3.a-head", "text"),
    image=("img.a-media_img", "@data-src"),
    link_prefix="https://pamfleti.net",
    content="div.all-content p, div.all-content div.kodiim",
    rules=(
        BlockRule("p", "text", "paragraph"),
        BlockRule("p", "iframe", "iframe"),
        BlockRule("p", "image", "image"),
        BlockRule("div", "iframe", "iframe", class_part="kodiim", key="src"),
    ),
    text_mode="first",
    lead_image=("div.all-content div.horizontal.imazhiim img", "@src"),
    paragraph_image=("div.all-content p img", "@src"),
    date=("span.a-date", "text"),
    date_form="named_month",
)

SYRI = SiteProfile(
    source="syri",
    hosts=("https://www.syri.net/", "https://syri.net/"),
    listings=("https://www.syri.net/politike",),
    category_piece=-1,
    card="div.categ-left, div.col-sm-6.col-xs-12.new-style, div.col-md-3.col-sm-6.col-xs-12.news-box.blue, div.col-md-4.col-sm-4.col-xs-12.news-box.blue",
    link=("a, a *", "@href"),
    title=("a h1, a h2", "text"),
    image_style=("div.categ-lg", "@style"),
    image=("div.img-cover, div.categ-sm.img-cover, div.img-holder.img-cover", "@data-original"),
    image_prefix="https://syri.net",
    content="div.readmore-text-here p",
    rules=(
        BlockRule("p", "text", "paragraph"),
        BlockRule("p", "image", "image"),
        BlockRule("p", "iframe", "iframe"),
    ),
    text_mode="join",
    lead_image=("div.prime-left.readmore iframe, div.prime-left.readmore img", "@src"),
    date=("span.date strong", "text"),
    date_form="time_date",
    gallery=("img", "@src"),
    gallery_root="div.fotogaleri",
)

PROFILES = (LAPSI, PAMFLETI, SYRI)
