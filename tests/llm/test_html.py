import re
import time
from html import unescape

import numpy as np
import pytest

from cytomix.llm import html as H


@pytest.fixture(scope="module")
def forest(spark):
    return H.fit(spark)


def plain(article):
    """Text of an article that holds only headings, paragraphs, bold words and breaks."""
    return " ".join(unescape(re.sub(r"<(/?)(\w+)[^>]*>", lambda m: "" if m[2] == "b" else " ", article)).split())


def test_given_pages(spark, forest):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain(re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in H.extract(pages, forest).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_held_out_layouts(forest):
    right = total = 0
    for seed in range(100_000, 100_200):
        html, labels = H.sample_page(seed)
        page = H.Page(html)
        got = page.decode(forest.probability(page.features()))
        total += sum(page.own)
        right += sum(n for n, a, b in zip(page.own, got, labels, strict=True) if a == b)
    assert right > 0.97 * total


def test_decoding_has_no_contradictions(forest):
    for seed in range(200_000, 200_040):
        page = H.Page(H.sample_page(seed)[0])
        main = page.decode(forest.probability(page.features()))
        for i in range(len(main)):
            path, j = [], i
            while j >= 0:
                path.append(int(main[j]))
                j = page.parent[j]
            assert re.fullmatch("0*1*0*", "".join(map(str, path)))


def test_edges(spark, forest):
    rows = [(1, None), (2, ""), (3, "<"), (4, "<p>" * 3000 + "x"), (5, "<article><p>A &lt;b&gt; &amp;copy;&nbsp; &#x41;<br>B<b>c</b>d\n\t e<script>x</p></article>"), (6, "<article><p>" + "long words here " * 20000 + "</p></article><footer>end</footer>"), (7, '<a "' * 2000)]
    pages = spark.createDataFrame([(i, h, "u", -1) for i, h in rows], "page_id long, html string, url string, n_chars int")
    got = {r.page_id: r.text for r in H.extract(pages, forest).collect()}
    assert got[1] == got[2] == "" and got[5] == "A <b> &copy; A Bcd e" and got[6] == ("long words here " * 20000).strip()
    assert H.extract(pages.limit(0), forest).count() == 0


@pytest.mark.parametrize(("html", "text"), [
    ("Let <math><mi>x</mi></math> be", "Let x be"), ("<object>in place of it</object>", "in place of it"), ('<p class="x>broken', "broken"), ('<p class="x>broken</p><p class="y">fine</p>', "broken fine"),
    ('<a title="a > b">q</a> 1 < 2', "q 1 < 2"), ("a <!-- b --> c <!-- d", "a c"), ("<p>it's <b>that's</b></p>", "it's that's"), ("<title>t</title><p>a</p></html>b", "a b"),
])
def test_markup(html, text):
    page = H.Page(html)
    assert page.text(np.ones(len(page.tag), bool)) == text


@pytest.mark.parametrize("part", ["<a ", "<div>", "<p>", '<a "', "<p a='b\" ", "<div><li>", "<table><div><td>x", "<!-- ", "<script>", "<", "&", '<a b="c>" d>', '<p a="x>'])
def test_a_long_broken_page_takes_linear_time(part):
    began = time.perf_counter()
    page = H.Page(part * (1_000_000 // len(part)) + ("</section>" * 20_000 if part == "<div>" else ""))
    page.decode(np.full(len(page.tag), 0.5))
    assert time.perf_counter() - began < 10


def test_pages_with_other_names(forest):
    body = "<h1>How rivers move</h1><p>Water finds the lowest way and takes sand along with it, grain by grain, for as long as it flows.</p><p>After a flood the bed has often moved by more than a field's width, as old maps show.</p>"
    menu = "<ul>" + "".join(f'<li><a href="/{i}">Topic {i}</a></li>' for i in range(8)) + "</ul>"
    for wrap in ('<div class="txt">{}</div>', '<section id="lead"><div>{}</div></section>', '<td class="mainbox">{}</td>', "<main>{}</main>"):
        html = f'<html><body><div class="topline">{menu}</div>{wrap.format(body)}<div class="bottomline"><a href="/a">About</a> <a href="/b">Contact</a></div></body></html>'
        (text,) = H.main_text([html], forest)
        assert plain(body[body.index("<p>") :]) in text and "Topic" not in text and "Contact" not in text, wrap


W = "the quick brown fox jumps over the lazy dog near a quiet river bank while the sun sets slowly behind old hills and trees"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<p>{W}</p><p>{W} again.</p>", f"{W} {W} again."),
        (f"{W} and {W}", f"{W} and {W}"),
        (f"<html><body><p>{W}</p></body></html>", W),
        (f"<body>{W}<p>{W}</p></body>", f"{W} {W}"),
        (f"<div class=c2><h1>Bridge news</h1><p>{W}</p></div>", f"Bridge news {W}"),
        (f"<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav><p>{W}</p><p>{W}</p><footer>&copy; 2020 Someone</footer>", f"{W} {W}"),
        (f"<h1>Title here</h1><p>{W}</p>", f"Title here {W}"),
        ("<p>Short one.</p>", "Short one."),
        ("<nav><ul><li><a href=/a>Home</a></li></ul></nav>", ""),
        (f"<body><h1>Bridge news</h1>{W}<br>{W}<div id=comments><p>nice post</p></div></body>", f"Bridge news {W} {W}"),
        (f"<table><tr><td>{W}</td></tr></table>", W),
        (f"<div><div><div>{W}</div></div></div>", W),
        (f"<header>My site</header><h2>News of the day</h2><p>{W}</p><aside><h3>Related</h3><p>more links here</p></aside>", f"News of the day {W}"),
    ],
)
def test_pages_without_wrapper(forest, page, text):
    assert H.main_text([page], forest) == [text]
