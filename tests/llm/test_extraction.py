import html
import re

from tarn.llm import extraction

SCHEMA = "page_id long, url string, html string, text string"


def articles(spark):
    """Expected texts of the generated pages, which have one article element of h1, p, b and br."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    want = {}
    for r in rows:
        body = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    return rows, want


def test_generated_pages(spark):
    rows, want = articles(spark)
    out = {r.page_id: r.text for r in extraction.extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert out == want


def test_held_out_pages_without_marks(spark):
    """Weights from half of the pages find the article of the other half when its element is renamed."""
    rows, want = articles(spark)
    weights = extraction.fit([r.html for r in rows if r.page_id % 2])
    rest = [r for r in rows if not r.page_id % 2]
    got = [extraction.extract(r.html.replace("article>", "section>"), weights) == want[r.page_id] for r in rest]
    assert sum(got) / len(got) >= 0.95


def test_held_out_pages_without_marks_and_list(spark):
    """The same without any prior names: all that tells parts of a page apart is fitted."""
    rows, want = articles(spark)
    weights = extraction.fit([r.html for r in rows if r.page_id % 2], prior=frozenset())
    rest = [r for r in rows if not r.page_id % 2]
    got = [extraction.extract(r.html.replace("article>", "section>"), weights) == want[r.page_id] for r in rest]
    assert sum(got) / len(got) >= 0.95


def test_names_that_state_a_property():
    """Theme classes on body, article, wrappers and headings don't make a text an aside."""
    w = extraction.fit([])
    text = "A headline\nWords of an article that has comments and that goes on for a while"
    inner = "<h2 class='section-header'>A headline</h2><p>Words of an article that has comments and that goes on for a while</p>"
    for page in (
        f"<body class='comments-open no-sidebar'><article>{inner}</article></body>",
        f"<body class='menu header'><article class='has-comments sidebar'>{inner}</article></body>",
        f"<div class='layout no-sidebar header-fixed'>{inner}</div>",
        f"<div class='site-header'>Name of this site</div><div>{inner}</div><div class='comment-list'>I do not agree at all</div>",
    ):
        assert extraction.extract(page, w) == text


def test_labelled_pages_overrule_the_prior():
    article = "<article><p>" + "good words of a text " * 30 + "</p><div class='ad'>Buy this now</div></article>"
    w = extraction.fit([f"<div class='related'>{article}</div><div class='odd'>Not this line</div>"] * 50)
    page = "<div class='related'><p>" + "good words of a text " * 30 + "</p><div class='ad'>Buy this now</div></div><div class='odd'>Not this line</div>"
    assert extraction.extract(page, w) == "good words of a text " * 29 + "good words of a text"


def test_marks_are_evidence_and_the_scan_decides():
    w = extraction.fit([])
    long = "many words of the long text of this page " * 20
    assert extraction.extract(f"<article>a short teaser</article><div><p>{long}</p></div>", w).endswith(long.strip())
    nested = f"<article><p>{long}</p><article><p>inner text here</p></article></article><p>beside it</p>"
    assert extraction.extract(nested, w) == f"{long.strip()}\ninner text here"
    several = f"<main><article><p>{long}</p></article></main><p>between them</p><article><p>{long}</p></article>"
    assert extraction.extract(several, w) == f"{long.strip()}\n{long.strip()}"
    assert extraction.extract(f"<article><p>{long} <math><mi>x</mi><mo>+</mo><mi>y</mi></math> done</p></article>", w) == f"{long.strip()} x+y done"


LAYOUT = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<div id="cookie-notice">We use cookies to make this site better for all of you</div>
<header><h1>Site name</h1><ul><li><a href=/>Home</a><li><a href=/x>About us</a></ul></header>
<div class="content"><h2>A  headline</h2><p>First &amp; best paragraph,\n with <a href="q">a link in</a> it and more words.
<script>var x = "<p>not this</p>";</script><div class="ad">Buy now cheap</div><p>Second paragraph is here<br>and goes on &eacute;&#233;.
<table><tr><td>one<td>two</table></div>
<div class="sidebar"><p>Other stories that are long enough to be read as text by itself</p></div>
<form><p>Your name and your mail address please</p><textarea>xx</textarea></form>
<div class="comments"><p>I am a reader and I think that this is all wrong and too long as well</p></div>
<footer>All rights reserved by us and nobody else</footer></body></html>"""


def test_layouts():
    w = extraction.fit([])
    text = "A headline\nFirst & best paragraph, with a link in it and more words.\nSecond paragraph is here and goes on éé.\none\ntwo"
    assert extraction.extract(LAYOUT, w) == text
    marked = LAYOUT.replace('<div class="content">', "<main>").replace('</table></div>', "</table></main>")
    assert extraction.extract(marked, w) == text
    assert extraction.extract("just plain text & no <b>tags", w) == "just plain text & no tags"
    for junk in ("", "<", "<p", "<!-- open", "<script>x", "</p></p>", "&#0;&#xD800;", "<p>\x00</p>", "<nav>a</nav>"):
        assert isinstance(extraction.extract(junk, w), str)


def test_nulls_and_long_pages(spark):
    long = "<p>" + "word <i>x</i> " * 200_000 + "</p>"
    rows = [(1, None, None, "mine"), (None, "u", "", None), (2, "u", long, ""), (2, "u", long, "")]
    out = extraction.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 1_399_999, 1_399_999]
    assert extraction.extract_pages(spark.createDataFrame([], SCHEMA)).collect() == []
