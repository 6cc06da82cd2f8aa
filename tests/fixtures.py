"""Small inline rows for semantics the driver tables do not contain."""

LAPSI_LISTING = """<html><body><div id="content">
<article><img src="/t1.jpg"><div class="post-content-wrapper"><h3><a href="https://lapsi.al/a1">Titull 1</a></h3></div></article>
<article><div class="post-content-wrapper"><a href="https://lapsi.al/a2">Titull <b>2</b></a></div></article>
<article><div class="other"><a href="https://lapsi.al/none">nothing</a></div></article>
</div><article><div class="post-content-wrapper"><a href="https://lapsi.al/out">outside</a></div></article></body></html>"""

LAPSI_ARTICLE = """<html><body><div class="post-preview"><img src="https://lapsi.al/big.jpg"></div>
<div class="entry-meta"><time class="published" datetime="2024-10-21T14:30:00+02:00">x</time></div>
<div class="entry-content"><p>t<iframe src="i"></iframe></p><p>a<b>b</b> c</p><p> </p><p></p>
<div class="wp-video x"><video><source src="v"></video></div><div>plain</div>
<section><p>nested, not a child</p></section></div></body></html>"""

PAMFLETI_LISTING = """<div class="c-flexy shtoketu x"><article class="a-card"><a href="/one"><img class="a-media_img" data-src="d.jpg"></a>
<h3 class="a-head">Kreu</h3></article></div>"""

PAMFLETI_ARTICLE = """<span class="a-date">21 Tetor, 2024 14:30</span><div class="all-content">
<p>t<iframe src="i"></iframe></p><p><img src="g"><iframe src="i2"></iframe></p><p>a<b>b</b> c</p><p> </p>
<div class="kodiim"><iframe src="e"></iframe></div></div>"""

SYRI_LISTING = """<div class="categ-left"><a href="/lajm/1"><h1>Nje</h1></a><div class="categ-lg" style="background:url('/i.jpg') x url(b)"></div></div>
<div class="col-md-3 col-sm-6 col-xs-12 news-box blue"><a href="https://www.syri.net/lajm/2"><h2>Dy</h2></a>
<div class="img-holder img-cover" data-original="https://cdn/x.jpg"></div></div>
<div class="col-md-3 news-box blue"><a href="/no">no</a></div>"""

SYRI_ARTICLE = """<div class="prime-left readmore"><img src="/lead.jpg"><span class="date"><strong> 14:30 </strong><strong>21/10/2024</strong></span>
<div class="readmore-text-here"><p>t<iframe src="i"></iframe></p><p><img src="g"><iframe src="i"></iframe></p>
<p>a<b>b</b> c</p><p> &nbsp; </p></div></div><div class="fotogaleri"><img src="/g1.jpg"><img src="https://cdn/g2.jpg"></div>"""

PAGES = [
    (1, "https://lapsi.al/kategoria/te-fundit/", LAPSI_LISTING),
    (2, "https://lapsi.al/a1", LAPSI_ARTICLE),
    (3, "https://pamfleti.net/category/aktualitet/", PAMFLETI_LISTING),
    (4, "https://pamfleti.net/one", PAMFLETI_ARTICLE),
    (5, "https://www.syri.net/politike", SYRI_LISTING),
    (6, "https://www.syri.net/lajm/1", SYRI_ARTICLE),
    (7, "https://elsewhere.example/", "<p>other</p>"),
]
