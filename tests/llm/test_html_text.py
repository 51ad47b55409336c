"""HTML extraction against a plain version on all test pages, in the cases its docstring defines, and in time."""

import time
from html.parser import HTMLParser
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from verilume.llm import html_text

PAGES = Path("/root/testdata/sf0.01/pages.parquet")
PAGE = "page_id long, url string, html string"


class Plain(HTMLParser):
    """The text of every block inside the article element: what the main text of the test pages is by construction."""

    BREAKS = set("p h1 ul li div article nav footer html head body title".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out, self.now = 0, [], []

    def flush(self):
        if text := " ".join("".join(self.now).split()):
            self.out.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS:
            self.flush()
        if tag == "br":
            self.now.append(" ")
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.now.append(data)


def plain(page):
    p = Plain()
    p.feed(page or "")
    p.close()
    p.flush()
    return "\n\n".join(p.out)


def test_all_pages_equal_the_plain_version(spark):
    pages = spark.read.parquet(str(PAGES))
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()} and len(got) > 200


LONG = "word " * 40
CASES = {
    "head without an end": ("<html><head><title>t</title><body><article><p>Hello world.</article>", "Hello world."),
    "self-closed svg": ('<p>Before <svg width="3"/> after</p><p>Second para here.</p>', "Before after\n\nSecond para here."),
    "layout class": ('<div class="with-sidebar"><article><p>Text of it.</p></article></div>', "Text of it."),
    "layout id": ('<div id="content-header-wrap"><article><p>Text of it.</p></article></div>', "Text of it."),
    "marked wrapper": ('<div class="sidebar"><article><p>Text of it.</p></article></div>', "Text of it."),
    "part of a class inside an article": (f'<article><h1>T</h1><section class="social-history"><p>{LONG}</p></section></article>', "T\n\n" + LONG.strip()),
    "inline advert": ('<article><p>Good text <span class="advert">Buy now cheap</span> rest</p></article>', "Good text rest"),
    "menu inside an article": ("<article><p>a</p><ul><li><a href=x>One</a><li><a href=y>Two</a><li><a href=z>Three</a></ul><p>b</p></article>", "a\n\nb"),
    "link between paragraphs": (f"<article><p>{LONG}</p><p><a href=x>Here</a></p><p>{LONG}</p></article>", f"{LONG.strip()}\n\nHere\n\n{LONG.strip()}"),
    "no article": (f'<div class="sidebar"><p>{LONG}</p></div><p>Main {LONG}</p><div class="cookie-notice">We use {LONG}</div><footer>c</footer>', "Main " + LONG.strip()),
    "comments": (f'<article><p>{LONG}</p></article><section id="comments"><article class="comment"><p>I say {LONG}</p></article></section>', LONG.strip()),
    "form around all": (f"<form action=x><p>{LONG}</p></form>", LONG.strip()),
    "no tags": ("1 < 2 and more", "1 < 2 and more"),
    "unclosed quote": ('<p>three <a href="foo>four</a> five</p>', "three four five"),
    "references once": ("<p>a &amp;lt; b &nbsp;\n c</p>", "a &lt; b c"),
    "unclosed button": (f"<button>x<p>{LONG}</p>", "x\n\n" + LONG.strip()),
    "unseen": ("<textarea>no</textarea><noscript>no</noscript><p hidden>no</p>yes<!-- no --><script>no</script>", "yes"),
}


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    page, want = CASES[case]
    assert html_text.main_text(page, html_text.trained()) == want


@pytest.mark.parametrize("piece", ["<a", "<div><p>", "<b>", "<!--", '<a href="', "<script>", "<a ='", "</b>", "&", "<title>", "<a x= ", "<span class=ad>a"])
def test_time_is_linear(piece):
    def took(n):
        began = time.process_time()
        html_text.main_text(piece * n + "<p>end", html_text.trained())
        return time.process_time() - began

    assert took(40_000) < 12 * took(8_000) + 0.5


def features_used(tree):
    if isinstance(tree, bool):
        return set()
    f, _, low, high = tree
    return {html_text.FEATURES[f]} | features_used(low) | features_used(high)


def test_neighbours_decide():
    tree = html_text.trained()
    assert {"words", "links", "links_before", "words_after", "links_after"} <= features_used(tree)
    between_links = (4, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0)
    between_text = (4, 0.0, 60, 0.0, 60, 0.0, 0, 0, 0, 0)
    assert not html_text.decide(tree, between_links) and html_text.decide(tree, between_text)


def test_odd_tables(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, None, "")]
    d = spark.createDataFrame(rows, PAGE).withColumn("text", F.lit(3)).withColumn("n_chars", F.lit("x"))
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(d).collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert html_text.extract(d.limit(0)).count() == 0
