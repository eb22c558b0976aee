"""Main text of pages: the cut against all labellings, odd markup, and the pages table."""

import html
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from refloom.llm import html_mincut as H
from refloom.llm import queries


def cost(scores, edges, labels):
    return sum((s < 0) * -s if kept else (s > 0) * s for s, kept in zip(scores, labels, strict=True)) + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_the_cut_is_the_cheapest_of_all_labellings():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 9)
        scores = [rng.choice([-2, -1, -0.5, 0, 0.3, 1, 3]) * rng.random() for _ in range(n)]
        edges = [(a, b, rng.random()) for a in range(n) for b in range(a) if rng.random() < 0.5]
        least = min(cost(scores, edges, x) for x in itertools.product([False, True], repeat=n))
        assert cost(scores, edges, H.cut(scores, edges)) == pytest.approx(least)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>if(a<b){x="</p>"}</script></head><body class="with-sidebar">
<header class="top"><a href=/>Home</a></header><nav><ul><li><a href=1>One<li><a href=2>Two</ul></nav>
<div class="cookie-notice">We use cookies on this site. Please accept.</div>
<div id="wrap"><div class="content-main"><h1>Title &amp; more</h1><p class=lead>First   paragraph, with a <a href="x>y">link</a>
and&nbsp;words.<p>Second<br>one.<div class="ad">Buy this now, it is very good and cheap.</div><p>Third.</p><!-- <p>no</p> -->
<blockquote>Quoted text &lt;here&gt;.</blockquote><form><label>Mail</label><input><button>Go</button></form></div>
<aside class="sidebar"><h3>Related</h3><p>Other story of great interest to every reader of this page.</p></aside></div>
<section id="comments"><article class="comment"><p>I liked this article very much, thank you for it.</p></article></section>
<footer>&copy; 2020 Someone. All rights reserved.</footer></body></html>"""


def test_a_page_without_article():
    assert H.main_text(PAGE) == (
        "Title & more\nFirst paragraph, with a link and words.\nSecond one.\nThird.\nQuoted text <here>."
    )


@pytest.mark.parametrize(
    "page", [None, "", " ", "<", "<p", "<!--", "<script>", "</p></div>", "<<>>", "&", "<p class='x>y", '<p a="', "<nav>only</nav>", "\x00"]
)
def test_broken_pages(page):
    assert isinstance(H.main_text(page), str)


def test_long_and_deep_pages():
    deep = "<div>" * 20_000 + "text and words." + "</div>" * 20_000
    assert H.main_text("<article>" + deep + "</article>") == "text and words."
    many = "<article>" + "<p>A sentence of words.</p>" * 20_000 + "</article>"
    assert H.main_text(many).count("\n") == 19_999


def plain(page):
    """What the layout of the pages table calls its article: h1 and paragraphs between the article tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n".join(t for t in texts if t)


def test_query(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op1_html_mincut(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize("rows", [0, 1])
def test_nulls_and_clashing_names(spark, rows):
    data = [(None, None, None), (1, "u", ""), (1, "u", "<article><p>Some words.</p></article>")] * 2 if rows else []
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = H.extracted(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.n_chars for r in out.collect()) == [0, 0, 0, 0, 11, 11][: len(data)]
