from pyspark.sql import functions as F

from storygraph.functions.dates import parse_day_month_year, parse_iso, parse_named_month, utc_day
from storygraph.functions.text import article_text, paragraphs, refresh_text, short_text, token_count, truncate_tokens
from storygraph.functions.urls import absolute_url, resolve_url, source_name, strip_quotes, style_url, url_category
from storygraph.functions.vectors import cosine_similarity, unit_vector, usable
from storygraph.operators.summarize import parse_summary


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_named_month(spark):
    cases = {
        "21 Tetor, 2024 14:30": 1729513800,
        "05 Janar, 2025 09:15": 1736064900,
        "5 Janar, 2025 9:15": 1736064900,
        " 21 Tetor, 2024  14:30 ": 1729513800,
        "27 Tetor, 2024 02:30": 1729992600,
        "31 Mars, 2024 02:30": 1711848600,
        "21 October, 2024 14:30": None,
        "21 Tetor 14:30": None,
        "x Tetor, 2024 14:30": None,
        "": None,
        None: None,
    }
    got = values(spark, "i int, t string", list(enumerate(cases)), "i", parse_named_month(F.col("t")))
    assert [v for _, v in sorted(got)] == list(cases.values())


def test_other_date_forms(spark):
    rows = [("2024-10-21T14:30:00+02:00",), ("2024-10-21T12:30:00Z",), ("2024-10-21T14:30:00",), ("soon",), (None,)]
    assert [v for (v,) in values(spark, "t string", rows, parse_iso(F.col("t")))] == [1729513800] * 3 + [None, None]
    rows = [("21/10/2024", " 14:30 "), ("05/01/2025", "09:15"), ("21/10/2024", None), ("x", "y")]
    got = values(spark, "d string, t string", rows, parse_day_month_year(F.col("d"), F.col("t")))
    assert [v for (v,) in got] == [1729513800, 1736064900, None, None]
    assert values(spark, "t bigint", [(1729513800,)], utc_day(F.col("t"))) == [(1729468800,)]


def test_urls(spark):
    row = values(
        spark,
        "u string, s string, r string, n string",
        [("https://a/b/c/", "x url('/i.jpg') url(b)", "/p", "Lapsi_AL")],
        url_category(F.col("u"), -2),
        strip_quotes(style_url(F.col("s"))),
        style_url(F.col("r")),
        absolute_url(F.col("r"), "https://h"),
        absolute_url(F.col("u"), "https://h"),
        absolute_url(F.col("u"), "https://h", always=True),
        source_name(F.col("n")),
    )
    assert row == [("c", "/i.jpg", None, "https://h/p", "https://a/b/c/", "https://hhttps://a/b/c/", "lapsi")]


BLOCKS = "title string, summary string, content array<struct<type:string, content:string>>"


def test_links_resolve_as_urljoin_does(spark):
    from urllib.parse import urljoin

    bases = ["https://www.syri.net/politike", "https://a.b/c/d/e?x=1#y", "http://h.de", "http://h.de/", "https://h.de/a/b/"]
    links = ["https://x.y/z", "mailto:a@b.c", "//cdn.x/g2.jpg", "/lajm/9", "lajm/9", "?q=1", "#top", "..", ".", "../x", "../../../x", "./x/./y/../z?u=/../v", "", "x/..", "/a/../b/."]
    rows = [(b, link) for b in bases for link in links]
    got = values(spark, "b string, l string", rows, resolve_url(F.col("b"), F.col("l")))
    assert [g[0] for g in got] == [urljoin(b, link) for b, link in rows]
    assert [g[0] for g in values(spark, "b string, l string", [(None, "x"), ("http://a/", None)], resolve_url(F.col("b"), F.col("l")))] == [None, None]


def test_texts(spark):
    content = [("paragraph", "one"), ("image", "i"), ("paragraph", "two")]
    t, s, c = F.col("title"), F.col("summary"), F.col("content")
    got = values(
        spark, BLOCKS, [("T", None, content), ("T", "S", content), (None, "S", content)],
        article_text(t, c), short_text(t, s, c), refresh_text(t, s), paragraphs(c),
    )
    assert got == [
        ("T one two", "T one two", "T", "one two"), ("T one two", "T S", "T S", "one two"), (None, None, None, "one two"),
    ]


def test_tokens(spark):
    rows = [("a  b\nc",), ("",), ("a b",)]
    got = values(spark, "t string", rows, token_count(F.col("t")), truncate_tokens(F.col("t"), 2))
    assert got == [(3, "a b"), (0, ""), (2, "a b")]


def test_similarity_is_never_nan(spark):
    nan = float("nan")
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([nan, 1.0], [1.0, 0.0]), (None, [1.0, 0.0])]
    got = values(spark, "a array<float>, b array<float>", rows, cosine_similarity(F.col("a"), F.col("b")), usable(F.col("a")))
    assert abs(got[0][0] - 0.5**0.5) < 1e-9
    assert got[1:] == [(None, False), (None, False), (None, False)] and got[0][1]


def test_unit_vector_of_zeros(spark):
    assert values(spark, "c array<bigint>", [([3, 4],), ([0, 0],)], unit_vector(F.col("c"))) == [
        ([0.6000000238418579, 0.800000011920929],), ([0.0, 0.0],),
    ]


def test_summary_json(spark):
    rows = [('{"cluster_title": "t", "cluster_content": "c"}',), ("{broken",)]
    got = values(spark, "j string", rows, parse_summary(F.col("j")).alias("s"))
    assert [(r.cluster_title, r.cluster_content) for (r,) in got] == [("t", "c"), (None, None)]
