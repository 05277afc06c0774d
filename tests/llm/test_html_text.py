import os
import re
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from kgspark.llm import html_text

PAGES = "/root/testdata/sf0.01/pages.parquet"

LONG = "A sentence with enough words to make a surge in the window sums of the page, and then some more."


def test_article_without_clutter():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
    <article><h1>Title &amp; more</h1><p>{LONG}<br>Second&nbsp;  line</p><div class="ad">Buy</div><p>Be.<p>Er &lt;b&gt; 1 < 2</p>
    <form><input>Mail <button>Go</button></form><div id="comments"><p>nice text by a reader, long enough to count as text</p></div></article>
    <aside>More</aside><footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page) == f"Title & more\n{LONG}\nSecond line\nBe.\nEr <b> 1 < 2"


def test_without_article_surge_and_dive():
    menu = "".join(f"<div><a href='/{i}'>Menu entry {i}</a></div>" for i in range(8))
    page = f"<body>{menu}<div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>{menu}<p>tiny</p></body>"
    assert html_text.main_text(page) == f"{LONG}\nShort.\n{LONG}"


def test_odd_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("<article><p>One two") == "One two"
    assert html_text.main_text("<article><p>One two</p><p>cut &am") == "One two\ncut &am"
    assert html_text.main_text("<article><p>One two</p><foot") == "One two"
    assert html_text.main_text("<article><p title='a>b'>One <b>two</b> <a href=x>three</a></p></article>") == "One two three"
    assert html_text.main_text("<article><script>x</article>") == ""
    assert html_text.main_text("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>").count("\n") == 4999
    assert html_text.main_text("<article><p " + "\"'" * 20_000 + ">One</p></article>") == "One"
    assert html_text.main_text("<head><title>T</title><p>" + LONG) == LONG  # a head that was not ended


def test_links():
    """Only ended links with a target are links; in an article, paragraphs of links are text too."""
    ten = "".join(f"<p>{LONG} {i}</p>" for i in range(10))
    for begin in ('<a name="top">', "<a href=x>", "<a name=top></a>"):
        assert html_text.main_text(f"<body>{begin}{ten}").count("\n") == 9
    assert html_text.main_text(f"<body>{ten}<p><a href=x>{LONG}</a></p>{ten}").count("\n") == 20
    assert html_text.main_text(f"<article><p>{LONG}<p><a href=x>See that</a></article>") == f"{LONG}\nSee that"


def test_class_names():
    """Words such as related are clutter for a holder, not for a paragraph."""
    page = f'<article><p class="related">{LONG}</p><p class="ad">Buy</p><div class="related"><p>More</p></div></article>'
    assert html_text.main_text(page) == LONG


def test_deep_nesting_is_linear():
    began = time.time()
    assert html_text.main_text("<div>" * 50_000 + LONG + "</p></li></div>" * 50_000) == LONG
    assert html_text.main_text("<a href=x><span>" * 30_000 + LONG) == LONG
    assert time.time() - began < 5


def test_points():
    """Sums of three lines: from a rise to the last line before they are nothing, if one reaches half of the largest."""
    weight = [0, 5, 0, 0, 0, 90, 0, 3, 0, 0, 2, 0, 0, 0, 50, 0, 0, 40, 0]
    assert html_text.stretches(html_text.np.array(weight)) == [(5, 10), (14, 17)]
    assert html_text.stretches(html_text.np.array([0, 4, 0, 0, 0, 9])) == [(5, 5)]
    assert html_text.stretches(html_text.np.array([7])) == [(0, 0)] and html_text.stretches(html_text.np.array([0, 0])) == html_text.stretches(html_text.np.zeros(0, int)) == []


class Article(HTMLParser):
    """Blocks of an article's text, read by a parser of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "br", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no pages")
def test_articles_of_pages_and_what_the_windows_do():
    """All text of marked articles and nothing else; without windows, or by single lines, no page comes out right or some do not."""
    pages = [r["html"] for r in pq.read_table(PAGES).to_pylist()]
    by_line = 0
    for page in pages:
        parser = Article()
        parser.feed(page)
        parser.close()
        want = "\n".join(t for b in parser.blocks if (t := re.sub(r"\s+", " ", b).strip()))
        found = html_text.lines(page)
        assert html_text.main_text(page) == want
        assert "\n".join(x.text for x in found if not x.clutter) != want
        weight = html_text.weights(found)
        by_line += "\n".join(x.text for x, w in zip(found, weight, strict=True) if w >= min(html_text.SURGE, weight.max() / 2)) != want
    assert by_line > len(pages) / 4


def test_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "z"), (1, "u", f"<article><p>{LONG}</p></article>", "z"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id or 0, r.text) for r in out.collect()) == [(0, ""), (1, LONG), (1, LONG)]
    assert html_text.extract(pages.limit(0)).count() == 0
