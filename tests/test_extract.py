import random
import time

from storygraph.operators.extract import article_records, extract_articles, extract_listing
from storygraph.operators.markup import Matcher, compile_selector, read_page, select
from storygraph.schemas import PAGES as SCHEMA
from tests.fixtures import PAGES


def pages(spark):
    return spark.createDataFrame([(*r, None) for r in PAGES], SCHEMA)


def test_nested_video_and_first_gallery(spark):
    lapsi = '<div class="entry-content"><div><div class="wp-video"><video><source src="v"></video></div></div><div class="x"><div class="wp-video"><video><source src="w"></video></div></div></div>'
    syri = '<div class="readmore-text-here"><p>t</p></div><div class="fotogaleri"><img src="g1.jpg"><img src="//cdn.x/g2.jpg"><img src="/g3.jpg"></div><div class="fotogaleri"><img src="/second.jpg"></div>'
    rows = spark.createDataFrame([(1, "https://lapsi.al/v", lapsi, None), (2, "https://www.syri.net/lajm/7", syri, None)], SCHEMA)
    got = {r.source: blocks(r) for r in extract_articles(rows).collect()}
    assert got["lapsi"] == [("video", "v", None)]
    assert [b[1] for b in got["syri"][1:]] == ["https://www.syri.net/lajm/g1.jpg", "https://cdn.x/g2.jpg", "https://www.syri.net/g3.jpg"]


def test_links_are_followed_wherever_they_lead(spark):
    card = '<div class="categ-left"><a href="{}"><h1>T</h1></a></div>'
    links = ["lajm/9", "//www.syri.net/lajm/8", "/lajm/7", "https://elsewhere.example/w"]
    urls = ["https://www.syri.net/lajm/9", "https://www.syri.net/lajm/8", "https://www.syri.net/lajm/7", "https://elsewhere.example/w"]
    page = '<div class="readmore-text-here"><p>text</p></div>'
    rows = [(0, "https://www.syri.net/politike", "".join(card.format(x) for x in links), None), *((i, u, page, None) for i, u in enumerate(urls, 1))]
    df = spark.createDataFrame(rows, SCHEMA)
    records = article_records(extract_listing(df), df).collect()
    assert sorted(r.article_url for r in records) == sorted(links) and {r.source for r in records} == {"syri"}


def test_listing_of_each_site(spark):
    rows = {(r.source, r.position): r for r in extract_listing(pages(spark)).collect()}
    assert len(rows) == 5
    a = rows["lapsi", 0]
    assert (a.article_url, a.title, a.thumbnail, a.category) == ("https://lapsi.al/a1", "Titull 1", "/t1.jpg", "te-fundit")
    assert rows["lapsi", 1].title == "Titull " and rows["lapsi", 1].thumbnail is None
    b = rows["pamfleti", 0]
    assert (b.article_url, b.title, b.thumbnail, b.category) == ("https://pamfleti.net/one", "Kreu", "d.jpg", "aktualitet")
    c = rows["syri", 0]
    assert (c.article_url, c.title, c.thumbnail, c.category) == ("/lajm/1", "Nje", "https://syri.net/i.jpg", "politike")
    assert rows["syri", 1].thumbnail == "https://cdn/x.jpg" and rows["syri", 1].title == "Dy"


def blocks(row):
    return [(b.type, b.content, b.src) for b in row.article_content]


def test_blocks_images_and_dates(spark):
    rows = {r.url: r for r in extract_articles(pages(spark)).collect()}
    a = rows["https://lapsi.al/a1"]
    assert blocks(a) == [
        ("iframe", "i", None), ("paragraph", "ab c", None), ("paragraph", " ", None), ("video", "v", None),
    ]
    assert (a.article_image, a.article_published_date) == ("https://lapsi.al/big.jpg", 1729513800)
    b = rows["https://pamfleti.net/one"]
    assert blocks(b) == [
        ("paragraph", "t", None), ("iframe", "i2", None), ("paragraph", "a", None), ("paragraph", " ", None), ("iframe", None, "e"),
    ]
    assert (b.article_image, b.article_published_date) == ("g", 1729513800)
    c = rows["https://www.syri.net/lajm/1"]
    assert blocks(c) == [
        ("paragraph", "t", None), ("image", "g", None), ("paragraph", "a b c", None),
        ("image", "https://www.syri.net/g1.jpg", None), ("image", "https://cdn/g2.jpg", None),
    ]
    assert (c.article_image, c.article_published_date) == ("https://syri.net/lead.jpg", 1729513800)


def test_records_join_listing_and_page(spark):
    p = pages(spark)
    rows = {r.source: r for r in article_records(extract_listing(p), p).collect()}
    assert {s: r.article_url for s, r in rows.items()} == {
        "lapsi": "https://lapsi.al/a1", "pamfleti": "https://pamfleti.net/one", "syri": "/lajm/1",
    }
    assert all(r.cluster_id is None for r in rows.values())


def test_unclosed_paragraphs_end_at_the_next_one():
    page = read_page("<article><p><b>one<br><p>two</p><script>var t='</p><p>';</script></article><p>out")
    assert len(select(page, compile_selector("article p"))) == 2
    assert len(select(page, compile_selector("article > p, p"))) == 3


def brute_select(page, selector, root):
    """Every element against every step, outwards."""

    def fits(node, step):
        _, tag, ident, classes = step
        attrs = page.attrs[node]
        return (not tag or page.tag[node] == tag) and (not ident or attrs.get("id") == ident) and (not classes or classes <= set(attrs.get("class", "").split()))

    def matches(node, steps):
        if not fits(node, steps[0]) or len(steps) == 1:
            return fits(node, steps[0])
        up = page.parent[node]
        while up >= root:
            if matches(up, steps[1:]):
                return True
            if steps[0][0]:
                return False
            up = page.parent[up]
        return False

    last = page.last[root] if root else len(page.tag) - 1
    return [n for n in range(root, last + 1) if any(matches(n, steps) for steps in selector)]


def random_page(draw, pieces):
    tags = ["div", "p", "a", "span", "li", "ul"]
    return "".join(
        draw.choice([f"<{t} class='{draw.choice(['x', 'y', 'x y'])}' id='{draw.choice('mn')}'>", f"</{t}>", "text"]) for t in (draw.choice(tags) for _ in range(pieces))
    )


def test_one_walk_answers_every_selector_below_every_element():
    draw = random.Random(1)
    for _ in range(200):
        page = read_page(random_page(draw, draw.randint(1, 40)))
        texts = [
            ", ".join(draw.choice([" ", " > "]).join(draw.choices(["div", "p", "a", ".x", "#m", "span.y", "*", "li"], k=draw.randint(1, 3))) for _ in range(draw.randint(1, 2)))
            for _ in range(5)
        ]
        selectors = {t: compile_selector(t) for t in texts}
        found = Matcher(selectors).run(page)
        for root in range(len(page.tag)):
            assert {t: found.select(t, root) for t in texts} == {t: brute_select(page, s, root) for t, s in selectors.items()}


def test_a_larger_page_takes_time_in_proportion():
    matcher = Matcher({str(k): compile_selector(f"div.x p, ul > li a, .c{k} span") for k in range(12)})
    times = []
    for n in (4000, 40000):
        page = read_page("<div class='x'>" + "<ul><li><a>t</a></li></ul><p class='c3'><span>u</span></p>" * (n // 5))
        start = time.process_time()
        found = matcher.run(page)
        times.append(time.process_time() - start)
        assert len(found.select("3")) == 3 * (n // 5)
    assert times[1] < 30 * times[0]
