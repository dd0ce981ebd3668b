import html
import re

import pytest
from pyspark.sql import functions as F

from poremetry.llm import html_extract as hx

SHELL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<div class="wrap"><div class="ad">Buy</div><%(tag)s class="post-%(n)d"><h2>Title &amp; more</h2><p>First&nbsp;par <b>bold
 text</b><p>Second <i>par</i>agraph &#8212; &eacute;<br>same block<ul><li>one<li>two</ul><form><p>Your mail</p></form><aside>See also</aside>
<!-- hidden > --><div class="share-buttons">Share</div><table><tr><td>a</td><td>b</td></tr></table></%(tag)s>
<div id="comments"><article class="comment"><p>Reader says hello and a lot of other things that make this longer than the article itself really</p></article></div></div>
<div class="sidebar">Side</div><footer>&copy; Site</footer></body></html>"""
WANT = "Title & more\nFirst par bold text\nSecond paragraph — é same block\none\ntwo\na b"


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_article_of_a_templated_host(spark, tag):
    rows = [(n, f"https://H.example/{n}", SHELL % {"tag": tag, "n": n}) for n in range(3)]
    got = hx.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.text for r in got} == {WANT} and {r.n_chars for r in got} == {len(WANT)}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://a/", "just text &lt;b&gt; &am"), (4, "http://a/", "<p>one<p>two</div></p>"), (4, "http://a/", "<p>one<p>two</div></p>"),
            (5, "http://b/", "<article><p>unclosed <b>bold"), (6, "http://b/", "<article a='><p>x"), (7, "http://b/", "<p>" + "word " * 40000)]
    pages = spark.createDataFrame([(*r, "w") for r in rows], "page_id bigint, url string, html string, winner string")
    got = {r.page_id: r.text for r in hx.extract(pages).collect()}
    assert hx.extract(pages).count() == len(rows)
    assert got[1] == got[2] == "" and got[3] == "just text <b> &am" and got[4] == "one\ntwo" and got[5] == "unclosed bold" and len(got[7]) == 199999
    assert hx.extract(pages.where("page_id < 0")).count() == 0


def test_driver_pages(spark):
    """The template of the table: the article, block by block, found here with patterns for that template only."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in hx.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b), r.page_id


def test_votes_agree(spark):
    rows = [(n, "http://h/", f"<body><div class='box{n}'><p>{'text ' * 30}</p></div></body>") for n in range(5)]
    won = hx.votes(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy(F.desc("score")).first()
    assert won.path == ">body>div.box"


WRAPPED = "<body><nav><a href='/'>Menu</a></nav>%s<footer>Foot</footer></body>"


@pytest.mark.parametrize("outer", ["<article>%s</article>", "<main><article class='p'>%s</article></main>", "<div class='post'>%s</div>", "<div class='box'>%s</div>"])
def test_title_beside_a_long_body(spark, outer):
    inner = "div" if "box" in outer else "div class='content'"
    page = lambda n: WRAPPED % (outer % f"<h1>Title {n}</h1><p>Lead</p><{inner}><p>{'word ' * 900}</p><math><mi>x</mi></math></div><figure><figcaption>Fig</figcaption></figure>")
    rows = [(n, "http://h/", page(n)) for n in range(4)] + [(9, "http://h/", WRAPPED % (outer % f"<h1>Title 9</h1><p>Lead</p><{inner}>brief</div>"))]
    got = {r.page_id: r.text.split("\n") for r in hx.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[9] == ["Title 9", "Lead", "brief"]
    assert all(got[n] == [f"Title {n}", "Lead", ("word " * 900).strip(), "x", "Fig"] for n in range(4))


def test_teaser_under_the_winning_path(spark):
    rows = [(n, "http://h/", WRAPPED % f"<article>{'text ' * 300}</article>") for n in range(4)]
    rows.append((9, "http://h/", WRAPPED % f"<article>Read on</article><section class='story'><h1>Own</h1>{'long ' * 300}</section>"))
    rows.append((8, "http://h/", WRAPPED % f"<article>Short one</article><div>{'unnamed ' * 3}</div>"))
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[9] == "Own\n" + ("long " * 300).strip() and got[8] == "Short one" and got[0] == ("text " * 300).strip()


def test_headings_and_ids_are_no_boilerplate():
    """Ids repeat a heading's words; headings and paragraphs go only where every word of their class says so."""
    kept = ['<h2 id="how-to-share-files">How to share files</h2>', '<h2 id="menu-of-the-day">Menu of the day</h2>',
            '<section id="search-algorithms"><p>Search in sorted lists takes few steps, as every step halves the list that is left.</p></section>',
            '<p class="related-work">Related work is older than this text and longer, too.</p>']
    body = "<p>" + "A long paragraph of the article with many words in it. " * 8 + "</p>"
    page = f'<html><body><div class="menu"><a href="/">Home</a></div><article><h1>Title</h1>{body}{"".join(kept)}<p class="advert">Buy now</p></article></body></html>'
    text = hx.Page(page).article(hx.best_path(hx.Page(page).container_scores()))
    assert all(w in text for w in ("How to share files", "Menu of the day", "Search in sorted", "Related work")) and "Buy now" not in text and "Home" not in text
