"""Main text of pages: parser cases, layouts of several kinds, and the driver's pages against plain patterns."""

import re
import time
from html import unescape

import pytest

from plumbline.llm import html_consensus as hc

SF = "/root/testdata/sf0.001"
LONG = "This paragraph is long enough to count as a part of the main text of its page, and it says number {}."


def by_patterns(html):
    """The driver's pages hold their text in one article of headings and paragraphs."""
    inner = html[html.index("<article>") + 9 : html.index("</article>")]
    parts = [" ".join(unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"<br>|</?p>|</?h1>", inner)]
    return "\n\n".join(x for x in parts if x)


def test_driver_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in hc.main_text(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == by_patterns(r.html)
        assert (got[r.page_id].url, got[r.page_id].n_chars) == (r.url, len(got[r.page_id].text))


LAYOUTS = {
    "plain divs": ('<body><div class="menu"><a href="/">Home</a></div><div class="c7">{}</div><div id="comments"><p>Reader says a lot about it, in fact more than is good for it and for us all.</p></div><div class="footer">End</div></body>', True),
    "main with aside": ("<body><header><h1>Site</h1></header><main><h1>Title</h1>{}<aside><p>Aside of the page that is quite as long as a paragraph of the main text of the page.</p></aside></main></body>", True),
    "form around all": ('<body><form action="x"><input><div class="post">{}</div><select><option>A<option>B</select></form></body>', False),
    "table cell": ('<body><table><tr><td class="nav"><a href="a">A</a><td class="text">{}</td></tr></table></body>', False),
    "noise words": ('<body class="has-sidebar"><div class="sidebar"><p>Side</p></div><article class="post-17 entry">{}<div class="share-buttons">Share</div><p class="notice">Beware</p></article></body>', False),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    layout, titled = LAYOUTS[name]
    texts = [LONG.format(k) for k in range(4)]
    page = hc.Page(layout.format("".join(f"<p>{t}" for t in texts)))
    got = hc.extract(page, [hc.path_of(page, hc.best_container(page))]).split("\n\n")
    assert got[-4:] == texts and len(got) <= 4 + titled
    assert got == hc.extract(page, []).split("\n\n")


def test_parser():
    text = lambda html: hc.extract(hc.Page(html), ["div"])
    assert text("<div>a &lt;b&gt; &#233;&nbsp;\n  c<br>d<i>e</i>f</div>") == "a <b> é c def"
    assert text('<div>a<script>var x = "</div><p>no</p>";</script>b<!-- <p>no</p> -->c</div>') == "abc"
    assert text("<div><ul><li>a<li>b<ul><li>c</ul><li>d</ul>e</div>") == "a\n\nb\n\nc\n\nd\n\ne"
    assert text("<div><p>a<p>b</i></p>c 1 < 2</div>") == "a\n\nb\n\nc 1 < 2"
    assert text('<div>a<span class="ad">no</span> b<button>no</button><span hidden>no</span></div>') == "a b"
    assert text("<div>a</div><div>b<style>p{}</style></div>") == "a\n\nb"
    assert text("<div>never ended <a href='x>y") == "never ended y"  # a quotation mark that is never closed: the tag ends at its first >
    assert text("<div>never ended <a href='x y") == "never ended"
    page = hc.Page('<html><div class="B post-12 a"><p>x</div>')
    assert hc.path_of(page, page.tag.index("div")) == "html>div.a.b.post-#"


@pytest.mark.parametrize("html", ["<" * 10**6, '<a "' * 250000, "<div>" * 200000, "<b>" * 100000 + "<li></li>" * 50000, "<!--" * 200000, "<a '>" + "<a>" * 200000, "</x>" * 200000, "<p><b>" * 100000, "x" * 3000000], ids=lambda h: h[:6])
def test_long_pages_take_linear_time(html):
    start = time.time()
    hc.extract(hc.Page(html), [])
    assert time.time() - start < 20


def test_the_host_decides(spark):
    """One page has the longer text in another container; the paths of its host's other pages win."""
    usual = '<html><body><div class="main-{}">{}</div><div class="x">Short.</div></body></html>'
    odd = '<html><body><div class="main-9"><p>Brief text.</div><div class="x">{}</div></body></html>'
    rows = [(k, "http://u@A.example.com:80/1" if k else "//a.example.com/9", usual.format(k, "<p>" + LONG.format(k))) for k in range(6)]
    rows += [(9, "https://a.example.com/odd", odd.format("".join(f"<p>{LONG.format(k)}</p>" for k in range(5)))), (10, None, odd.format(f"<p>{LONG}"))]
    got = {r.page_id: r for r in hc.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9].text == "Brief text." and got[9].host_paths[0] == "html>body>div.main-#"
    assert [got[k].text for k in range(6)] == [LONG.format(k) for k in range(6)]
    assert LONG in got[10].text


def test_odd_rows(spark):
    rows = [(1, None, None, "h"), (2, "http://a/", "", "h"), (None, "http://a/", "<p>x", "h"), (3, "nonsense", "x" * 2000000, "h"), (3, "nonsense", "x" * 2000000, "h"), (4, "http://b/", "<nav>only</nav>", "h")]
    got = hc.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string"))
    assert sorted(((r.page_id or 0), r.n_chars) for r in got.collect()) == [(0, 1), (1, 0), (2, 0), (3, 2000000), (3, 2000000), (4, 0)]
    assert hc.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_many_hosts_take_the_join(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted((r.page_id, r.text) for r in hc.main_text(pages).collect())
    monkeypatch.setattr(hc, "BROADCAST_BYTES", 0)
    assert sorted((r.page_id, r.text) for r in hc.main_text(pages).collect()) == want
