import html
import itertools
import random
import re

import __spark_entry__ as contract
import pytest
from helpers import SF
from tidemark.llm.html_cut import extract, main_text, minimum_cut

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Site</a>
</header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div id="cookie-notice">We use cookies. Accept them all now.</div>
<main><article><h1>A  head&shy;line</h1><p>First para with <a href=x>a link</a> &amp; more words here.<br>Second line.<script>var x="<p>no</p>";</script>
<p>Short.<ul><li>An item<li>Another item</ul><form><label>Your name</label><input></form>
<section class="comments"><p>Reader said something quite long about this, really.</p></section></article></main>
<aside class="sidebar"><p>Related stories that you might like to read next.</p></aside><div class="ad-banner">Buy this now, it is cheap.</div>
<footer>&copy; 2024 Site &middot; Terms</footer><!-- <p>hidden</p> --></body></html>"""


def test_page():
    text = main_text(PAGE)[0]
    assert text == "A head\xadline First para with a link & more words here. Second line. Short. An item Another item"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "a < b", "<p>x</p", "</p></div>", "<a href='", "&amp", "\x00"])
def test_broken_pages(page):
    assert isinstance(main_text(page)[0], str)


def test_query(spark):
    for r in contract.queries()["op2_main_text"](spark, SF).collect():
        page = spark_pages(spark)[r.page_id]
        body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        body = re.sub(r"<[^>]*(>|\Z)", "", re.sub(r"</?(p|h1)>|<br>", " ", body))
        assert r.text == " ".join(html.unescape(body).split()) and r.n_chars == len(r.text)


def spark_pages(spark, kept={}):
    if not kept:
        kept.update({r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()})
    return kept


def test_without_article_tags():
    nav = "<div>" + "".join(f"<a href=/{i}>Item {i}</a> " for i in range(8)) + "</div>"
    body = "".join(f"<p>This is paragraph {i} of the story, which goes on for a good while, with commas, and ends.</p>" for i in range(5))
    text = main_text(f"<body>{nav}<div>{body}</div><div class=footer>Imprint</div></body>")[0]
    assert text.startswith("This is paragraph 0") and "Item" not in text and "Imprint" not in text and "paragraph 4" in text


def test_cut_is_minimal():
    rand = random.Random(1)
    for _ in range(60):
        n = rand.randrange(1, 8)
        source, sink = [[round(rand.random() * 5, 2) for _ in range(n)] for _ in range(2)]
        edges = [(i, j, round(rand.random() * 3, 2)) for i, j in itertools.combinations(range(n), 2) if rand.random() < 0.6]

        def cost(on):
            return (sum(sink[i] if on[i] else source[i] for i in range(n)) + sum(c for i, j, c in edges if on[i] != on[j]))

        best = min(cost(on) for on in itertools.product((False, True), repeat=n))
        assert abs(cost(minimum_cut(source, sink, edges)) - best) < 1e-6


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (None, "", "t"), (2, "<p>" + "x " * 50000, "t")],
                                  "page_id long, html string, text string")
    got = extract(pages)
    assert got.count() == 4 and got.columns == ["page_id", "html", "text", "n_blocks", "n_content"]
    assert extract(pages.limit(0)).count() == 0


def test_svg_and_math_close_themselves():
    story = "A long story of many words that is the article of this page. " * 8
    for tag in ["<svg class='icon'/>", "<svg/>", "<math />", '<svg d="a=b"/>']:
        assert "A long story" in main_text(f"<html><body><article><p>{tag}{story}</p></article></body></html>")[0], tag
    for tag in ["<svg class=a/>", "<script/>"]:
        assert "A long story" not in main_text(f"<html><body><article><p>{tag}{story}</p></article></body></html>")[0], tag
