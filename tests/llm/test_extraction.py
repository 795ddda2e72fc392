"""Extraction: cuts against every labelling, parsing and whole pages against texts written by hand, the table against its template."""

import re
from html import unescape
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quizloom.llm import dom, extraction, queries

PRIOR = extraction.fit_bins(np.zeros((int(np.prod(extraction.SIZES)), 2)))
SCHEMA = "page_id long, url string, html string"


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_cut_is_minimal(data):
    n = data.draw(st.integers(1, 8))
    terminals = data.draw(st.lists(st.integers(-6, 6), min_size=n, max_size=n))
    edge = st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(0, 5))
    edges = [(min(a, b), max(a, b), w) for a, b, w in data.draw(st.lists(edge, max_size=14)) if a != b]

    def cost(labels):
        apart = sum(max(t, 0) if not x else max(-t, 0) for t, x in zip(terminals, labels, strict=True))
        return apart + sum(w for a, b, w in edges if labels[a] != labels[b])

    assert cost(extraction.minimum_cut(terminals, edges)) == min(map(cost, product([False, True], repeat=n)))


def test_long_chain_with_a_far_pull():
    n = 3000
    got = extraction.minimum_cut([50] + [-1 if k % 2 else 1 for k in range(n)] + [-50], [(k, k + 1, 3) for k in range(n + 1)])
    assert got[0] and not got[-1] and sum(a != b for a, b in zip(got, got[1:], strict=False)) == 1


def _text(html):
    return extraction.main_text(html, PRIOR)


ARTICLE = "<h1>Title here</h1><p>First part of the text, with words.</p><p>Second.</p>"
WANT = "Title here\nFirst part of the text, with words.\nSecond."


@pytest.mark.parametrize("around", [
    "<article>{}</article>",
    "<main><div>{}</div></main>",
    "<div class='page-with-sidebar'><div role=main>{}</div></div>",
    "<div id=content>{}</div>",
    "<form id=aspnet><main>{}</main></form>",
    "<article>{}<footer>Filed under things</footer><div class=share-buttons>Tell everyone about this, please.</div></article>",
    "<article>{}<section id=comments><article class=c><p>I never read a text that was as long as this, thank you.</p></article></section></article>",
    "<article>{}</article><section class=related><article><p>Another text that you may like.</p></article></section>",
])
def test_whole_pages(around):
    page = f"""<!DOCTYPE html><html><head><title>A &lt; b</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="sidebar">
    <header class=site><p>The name of the site, in a sentence of its own.</p></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
    <div class="cookie-notice">We use cookies, and you have to agree to that.</div><!-- <p>none</p> -->
    <div class="ad">A sentence that sells something to somebody.</div>{around.format(ARTICLE)}
    <aside><p>On the side there is some text, too.</p></aside><div id=sidebar><p>And here is more of it, in a div.</p></div>
    <form><p>Send us your address, and we write to you.</p><button>Go</button></form><footer>&copy; 2020</footer></body></html>"""
    assert _text(page) == WANT


def test_blocks():
    assert dom.parse("a<b>b</b> \n c<br>d<p>&lt;x&gt; &amp;amp; &#65;&nbsp;&unknown; 3 < 4<div>z").text == ["ab c d", "<x> &amp; A &unknown; 3 < 4", "z"]
    assert dom.parse("<ul><li>1<li>2<ul><li>3</ul>4</ul><table><tr><td>5<td>6<tr><th>7</table>").text == list("1234567")
    assert dom.parse("x<script>if (a < b) '</p>'</script >y<style>z").text == ["xy"]
    assert dom.parse("a <!-- b --> c <!-- d").text == ["a c"]
    assert dom.parse("a<?php b ?>c<!x>d</>e<p class='q").text == ["acde"]
    page = dom.parse("<p title='a > b' hidden class=\"Foo barBaz\">x</p></div></p>y")
    assert page.text == ["x", "y"] and page.words[0] == {"foo", "bar", "baz"} and page.hidden[0]
    page = dom.parse("<div><a href=x>in</a> out</div>")
    assert page.linked == [2]


def test_no_page_takes_long():
    n = 20_000
    for html in ("<div>" * n + "x", "<li><div>" * n, "</p></b>" * n, "<a " * n, "<a b='" * n, "<!-" * n, "<article><p>w" * n, "&#x" * n):
        assert isinstance(_text(html), str)
    assert _text("<article>" + "<p>w" * n) == "\n".join("w" * n)


def test_regression_learns_from_counts():
    counts = np.zeros((int(np.prod(extraction.SIZES)), 2))
    long_text, link = extraction._bins("word " * 50 + "end.", 0), extraction._bins("Home", 4)
    counts[link, 0], counts[long_text, 1] = 500, 500
    odds = extraction.fit_bins(counts)
    assert odds[long_text] > 2 > -2 > odds[link]
    assert (np.abs(odds) <= extraction.TEXT).all()
    assert np.allclose(PRIOR, np.clip(extraction._design() @ extraction.PRIOR, -extraction.TEXT, extraction.TEXT))


def test_odd_rows(spark):
    rows = [(1, "u", None, 5), (2, None, "", 5), (None, "v", "<p>Some text, again.</p>", 5), (4, "w", "<article>" + "<p>a b</p>" * 5000, 5)]
    df = spark.createDataFrame(rows + rows[2:3], SCHEMA + ", text int")
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in extraction.extract(df).collect()}
    assert got == {(1, "u"): ("", 0), (2, None): ("", 0), (None, "v"): ("Some text, again.", 17), (4, "w"): ("\n".join(["a b"] * 5000), 19999)}
    assert extraction.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark, tiny):
    got = {r["page_id"]: r for r in queries.QUERIES["op11_html_extraction"](spark, tiny).collect()}
    pages = spark.read.parquet(f"{tiny}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        inner = page["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(unescape(re.sub("<b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert got[page["page_id"]]["text"] == "\n".join(filter(None, blocks))
        assert got[page["page_id"]]["n_chars"] == len(got[page["page_id"]]["text"])


def test_any_string_of_tags_is_read():
    rng = np.random.default_rng(5)
    parts = [
        "<div>", "</div>", "<p>", "</p>", "<article>", "</article>", "<li>", "<ul>", "</ul>", "<b>", "<a href=x>", "</a>", "<td>", "<table>", "</table>", "<script>", "</script>", "<title>",
        "<!--", "-->", "<", ">", "&amp;", "&", "&#xD800;", "&#0;", "some words here.", "x", "<br>", "<button>", "</button>", "<svg/>", "<svg>", "<section class='comments'>", "<div class=ad>",
        "<nav>", "</nav>", "<body>", "</body>", "</html>", '"', "'", '<p class="', "\x00", " ", "é", "<select><option>", "<form>", "</", "<a", "<dd>",
    ]
    for _ in range(3000):
        text = _text("".join(rng.choice(parts, rng.integers(0, 60))))
        text.encode()
        assert "\n\n" not in text and text == text.strip("\n")
