"""HTML extraction on pages written by hand, not composed by the training generator, and on malformed markup."""

import time
from html import unescape

import pytest

from boxloom.llm import html_extraction as HX

#: (page, text of the article, block by block)
PAGES = [
    (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Tides | Harbour Weekly</title><link rel=stylesheet href=a.css></head>
<body class="single has-sidebar with-footer"><header id="top"><a class="logo" href="/">Harbour Weekly</a><nav aria-label="Main"><ul><li><a href="/news">News</a>
<li><a href="/boats">Boats</a><li><a href="/about">About us</a></ul></nav></header>
<div class="layout"><main><article class="post"><h1>Why the tide comes twice a day</h1>
<p>Most coasts see two high tides in a little more than a day, because the moon pulls the near ocean more than the Earth&rsquo;s centre.
<p>The far side bulges as well:   the Earth is pulled away from it, and water stays behind.</p>
<blockquote><p>Time and tide wait for no man, the proverb says, and the harbour master agrees.</p></blockquote>
<ul><li>Spring tides come at full and new moon.</li><li>Neap tides come at half moon.</li></ul>
<div class="share-buttons"><a href="#">Tweet</a> <a href="#">Share</a></div></article>
<section id="comments" class="comments"><h3>3 comments</h3><div class="comment"><p>Great explanation, thank you for writing this!</p></div><div class="comment"><p>My grandfather knew it all along.</p></div></section></main>
<aside class="sidebar"><h2>Popular</h2><ul><li><a href="/1">Knots for beginners</a></li><li><a href="/2">Ten lighthouses to see</a></li></ul></aside></div>
<footer class="site-footer"><p>&copy; 2023 Harbour Weekly. All rights reserved.</p></footer><script>ga('send');</script></body></html>""",
        ["Why the tide comes twice a day", "Most coasts see two high tides in a little more than a day, because the moon pulls the near ocean more than the Earth’s centre.", "The far side bulges as well: the Earth is pulled away from it, and water stays behind.", "Time and tide wait for no man, the proverb says, and the harbour master agrees.", "Spring tides come at full and new moon.", "Neap tides come at half moon."],
    ),
    (
        """<html><body><div id="cookie-banner" class="cookie-consent"><p>We use cookies to improve your visit.</p><button>Accept all</button></div>
<div class="navbar"><a href="/">Home</a> <a href="/recipes">Recipes</a> <a href="/contact">Contact</a></div>
<div class="container"><div class="entry-content"><h1>Lentil soup</h1><p>Soak the lentils overnight, then rinse them under cold water until it runs clear.</p>
<div class="ad">Buy our new pan today and save half of the price.</div>
<p>Fry two onions &amp; three carrots in oil, add the lentils and a litre of stock.</p><p>Simmer for forty minutes; season with salt, pepper and lemon.</p>
<table><tr><td>Serves</td><td>four</td></tr><tr><td>Time</td><td>one hour</td></tr></table></div>
<div class="related-posts"><h3>You may also like</h3><a href="/a">Pea soup</a><a href="/b">Leek and potato soup</a></div></div>
<div id="footer">Imprint | Privacy | Copyright 2020 Soup Kitchen</div></body></html>""",
        ["Lentil soup", "Soak the lentils overnight, then rinse them under cold water until it runs clear.", "Fry two onions & three carrots in oil, add the lentils and a litre of stock.", "Simmer for forty minutes; season with salt, pepper and lemon.", "Serves", "four", "Time", "one hour"],
    ),
    (
        """<html><body><form method="post" action="./page.aspx" id="aspnetForm"><input type=hidden name="__VIEWSTATE" value="abc=">
<div id="header"><h2>Town council</h2></div><div id="main"><h1>Minutes of the meeting</h1><p>The council met on Tuesday in the old hall, with nine members present and two excused.</p>
<p>It was resolved to repair the bridge before winter and to open a second bid for the school roof.</p><p>The next meeting will take place in March, when the budget of the library is to be discussed in full.</p></div>
<div class="search-form"><label>Search</label><input type=text><button>Go</button></div></form></body></html>""",
        ["Minutes of the meeting", "The council met on Tuesday in the old hall, with nine members present and two excused.", "It was resolved to repair the bridge before winter and to open a second bid for the school roof.", "The next meeting will take place in March, when the budget of the library is to be discussed in full."],
    ),
    (
        "<p>A page without any frame begins with a paragraph.</p><p>It goes on with another one, <i>partly slanted</i>, and ends.</p>",
        ["A page without any frame begins with a paragraph.", "It goes on with another one, partly slanted, and ends."],
    ),
    ("Only plain text stands here, 3 < 5 &amp; nothing else.", ["Only plain text stands here, 3 < 5 & nothing else."]),
    (
        """<html><body class="page has-footer"><noscript>Please enable scripts to use this site.</noscript><div><h1>On formulas</h1><p>The area of a disc is <math><mi>p</mi><mo>r</mo><mn>2</mn></math>, as every pupil learns in school.</p>
<p>A drawing <svg viewBox="0 0 1 1"><title>disc</title><circle r="1"/></svg> shows the disc with its radius and its centre.</p></div></body></html>""",
        ["On formulas", "The area of a disc is pr2, as every pupil learns in school.", "A drawing shows the disc with its radius and its centre."],
    ),
]


def test_pages_of_another_source():
    got = HX.extract([html for html, _ in PAGES], *HX.model())
    found, wanted, both = 0, 0, 0
    for text, (_, blocks) in zip(got, PAGES, strict=True):
        kept = text.split("\n\n")
        found, wanted, both = found + sum(map(len, kept)), wanted + sum(map(len, blocks)), both + sum(len(b) for b in kept if b in blocks)
    print(f"precision {both / found:.3f} recall {both / wanted:.3f}")
    assert both / wanted >= 0.95 and both / found >= 0.95


MALFORMED = [
    ('<img alt="5" tall"><p>two</p><p>three <a href="x">four</a>', "two\n\nthree four"),
    ("<p>one</p><a title=it's><p>two</p><p>three</p>", "one\n\ntwo\n\nthree"),
    ('<p title="never closed>text one</p><p>text two</p>', "text one\n\ntext two"),
    ("<!-- never closed <p>first</p><p>second</p>", "first\n\nsecond"),
    ("<p>a</p><!--><p>b</p><!-- c --!><p>d</p>", "a\n\nb\n\nd"),
    ("<p>one</p><script>never closed <p>two</p>", "one\n\nnever closed\n\ntwo"),
    ("<p>a &lt;b&gt; < c</p> </ p><? x ?><p>d", "a <b> < c\n\nd"),
    ('<div data-y="x" data-id="comments" aria-hidden="false" style="overflow:hidden"><p>kept text of a page</p></div>', "kept text of a page"),
    ("<p>cut off in a tag <b", "cut off in a tag"),
    ("<ul><li>one<ul><li>inner</ul><li>two</ul>", "one\n\ninner\n\ntwo"),
]


@pytest.mark.parametrize(("html", "text"), MALFORMED)
def test_malformed_markup(html, text):
    assert HX.extract([html], *HX.model()) == [text]


def test_labels_and_body_names_are_not_read_from_pages():
    page = HX.Page('<body class="footer sidebar"><div data-y="1" hidden>x</div><div style="display: none">y</div></body>')
    assert page.labels == [0] * 4 and page.marks[1] == () and page.marks[2] == page.marks[3] != ()


@pytest.mark.parametrize("piece", ["<a ", '<p title="x', "<!--", "<script>", "<a b='", "<", "</x", "<div></x>", "<td><li>", "&amp"])
def test_time_is_linear(piece):
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        HX.Page(piece * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_references_are_those_of_html():
    assert HX.extract(["<p>&copy; &notanentity; &#x41;&#66;</p>"], *HX.model()) == [unescape("&copy; &notanentity; AB")]
