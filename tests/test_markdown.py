"""Pages as markdown."""

import time

import pytest

from lectern.functions.markdown import to_markdown
from lectern.sources import corpus

PAGES = {
    "<p>caf&eacute; &#8212;</p><HEADER>x</HEADER><H1>Big</H1><table><tr><td>a</td><td>b</td>": "café —\nx\n# Big\n| a | b |\n| --- | --- |",
    "<ul><li>one<li>two <b>bold</b></ul>after": "- one\n- two bold\nafter",
    "<ol start=3><li>c<ul><li>in<ol><li>deep</ol></li></ul><li>d</ol>": "3. c\n  - in\n    1. deep\n4. d",
    "<ul><li><p>first</p><p>second</p></li></ul>": "- first\n  second",
    "<TABLE><tr><th>h|1<th>h2<tr><td>a<br>b<td><table><tr><td>x</td><td>y</td></tr></table></TABLE>t": "| h\\|1 | h2 |\n| --- | --- |\n| a b | x y |\nt",
    "<blockquote>q<p>r</blockquote>s<hr>": "> q\n> r\ns\n---",
    "<pre>a  b\n  c &lt;d</pre>e": "```\na  b\n  c <d\n```\ne",
    "<head><title>t</title></head><body>x<script>y<b></script>z<!-- c > d -->w": "xzw",
    "<head><meta><body><h2 class='a>b'>T\n  t</h2>&nbsp;u": "## T t\nu",
    "no tags &amp; 1 < 2": "no tags & 1 < 2", "": "", "<h3></h3><li> </li><td>cell</td>": "cell", "<ul><li><h4>T</h4>u</ul>": "- #### T\n  u", "</ul></table></pre></blockquote>ok": "ok", "<pre>open": "```\nopen\n```", "<style>a": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_markdown_of_a_page(page):
    assert to_markdown(page) == PAGES[page]


def test_pages_as_files(spark):
    rows = spark.createDataFrame([(1, "<H1>A</H1>b"), (2, None)], "page_id long, html string")
    assert sorted((r.rel_path, r.markdown, r.size_bytes) for r in corpus.from_pages(rows).collect()) == [("pages/1.html", "# A\nb", 5), ("pages/2.html", "", 0)]


@pytest.mark.parametrize("piece", ['<a "', "<!x ", "<div>", "</q>", "<!-- ", "<script>", "<table><tr><td>", "<ul><li>", "<a '\">", "<pre>\n"])
def test_long_bad_markup_takes_seconds(piece):
    start = time.process_time()
    to_markdown(piece * 100_000)
    assert time.process_time() - start < 10


def test_what_a_cut_has_left_of_a_reference_is_text():
    assert to_markdown("<h1>a &amp</h1>b &copy; &nosuch; &#65; &#66 &copy") == "# a &amp\nb © &nosuch; A &#66 &copy"
