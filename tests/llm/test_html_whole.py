"""Main text: the query against a brute-force reading of its whole table, templates, and odd pages."""

import re
from html import unescape

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quarry.llm import html, queries


def cut_out(page):
    """What the article of a page of the test table says, by cutting strings: its blocks are h1 and p, its other tags b and br."""
    inside = re.search("<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:h1|p)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_query_equals_brute_force(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op8_html_extraction(spark, SF).collect()
    assert {r.page_id for r in got} == set(pages) and len(got) == len(pages)
    assert all(r.text == cut_out(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


@pytest.mark.parametrize("held", [html.HELD, 0])
def test_templates_carry_the_result(spark, monkeypatch, held):
    monkeypatch.setattr(html, "HELD", held)
    body = "<body><div>{own}</div><div class=x><p>Read our terms</p></div><article><div><b>Share this</b></div><p>Text {k}</p><p>Quoted</p><ul><li><a href=/>Home</a></ul></article></body>"
    rows = [(k, f"http://h.example/{k}", body.format(k=k, own="Notice")) for k in range(8)]
    plain = "<body><div>Site line</div><div id=x><p>Text {k}</p></div><p>Site line</p><p>" + "Long quoted text. " * 20 + "</p></body>"
    rows += [(100 + k, f"http://g.example/{k}", plain.format(k=k)) for k in range(8)]
    rows += [(200 + k, "http://copies.example/", body.format(k=0, own=f"own {k}")) for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract(df).collect()}
    left = {r.page_id: r.text for r in html.extract(df, removal=False).collect()}
    assert got[3].text == "Text 3\nQuoted" and left[3] == "Share this\nText 3\nQuoted\nHome" and got[3].n_template > 2
    assert got[103].text == "Text 3" and left[103].startswith("Site line\nText 3\nSite line\nLong")
    assert got[205].text == left[205] == "Share this\nText 0\nQuoted\nHome" and got[205].n_template == 0


def test_html_template_on_few_pages_of_a_large_host(spark):
    body = "<body>{notice}<div id=x><p>Text {k}</p></div></body>"
    rows = [(k, f"http://h.example/{k}", body.format(k=k, notice="<div>Rare line</div>" if k < 6 else "<div>Four lines</div>" if k < 10 else "")) for k in range(60)]
    rows += [(90, "http://h.example/0", rows[0][2]), (None, None, rows[0][2]), (91, "http://other.example/", rows[0][2])]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in (0, 5, 6, 50, 90)] == ["Text 0", "Text 5", "Four lines\nText 6", "Text 50", "Text 0"]
    assert got[None] == got[91] == "Rare line\nText 0" and len(got) == 63


def test_templates_alone_find_the_text(spark):
    """Whatever tags and names say: on hosts with enough pages what recurs is the chrome, and what is left the article. The tables' hosts have 60 variants of their chrome each."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").withColumn("host", html.host(F.col("url")))
    many = pages.join(pages.groupBy("host").count().where("count >= 100"), "host")
    found = {k: {r.page_id: r.text for r in html.extract(many, **options).collect()} for k, options in {"all": {}, "alone": {"marks": False}, "none": {"marks": False, "removal": False}}.items()}
    share = lambda k: sum(found[k][i] == t for i, t in found["all"].items()) / len(found["all"])
    assert len(found["all"]) > 400 and share("alone") > 0.4 and share("none") == 0


@pytest.mark.parametrize("page, want", [
    ('<div class="layout has-sidebar"><article><p>Hi</p></article></div>', "Hi"),
    ('<div class="post no-comments"><p>Hi</p></div>', "Hi"),
    ('<form><nav>m</nav><article><p>Hi</p><div class="share-of-voice">Voice</div></article><input></form>', "Hi\nVoice"),
    ("<form><h1>T</h1><p>Hi</p><select><option>a</select></form>", "T\nHi"),
    ('<header>Site</header><article><header><h1>T</h1></header><p>x</p><section class="comments"><article class="comment"><p>c</p></article></section></article><aside><article><p>teaser</p></article></aside>', "T\nx"),
    ('<div id="comments" class="comments-area"><p>c</p></div><div id=content><p>one</p><div class="cookie-notice">We use</div><div class="ad-slot">Buy</div><ul class="share-buttons"><li>tw</ul></div>', "one"),
    ('<article><p>a&nbsp;&lt;b&gt;  c &amp;amp;</p><pre>x\n  y</pre><table><tr><td>1<td>2</table><script>no</script><style>no</style><p hidden>no</p></article>', "a <b> c &amp;\nx y\n1\n2"),
    ("<main><p>m</p></main><p>out</p>", "m"),
    ('<article><h1>Baking</h1><section id="cookies"><p>Cookies need butter.</p></section></article>', "Baking\nCookies need butter."),
    ('<article><h2 id="navigation">Navigation at sea</h2><p>a</p><h2 id="advertising">Advertising</h2><p>b</p></article>', "Navigation at sea\na\nAdvertising\nb"),
    ('<article><table><tr><td>Year</td><td class="share">5 %</td></tr></table><p class="reply">He said no.</p></article>', "Year\n5 %\nHe said no."),
    ('<article><p>a</p><ul class="share"><li><a href=x>tw</a></ul><div class="ad-slot">Buy</div><div class="related"><a href=y>more</a></div></article>', "a"),
    ("no markup &eacute;", "no markup é"),
    ("<p>a<!-- <p>no -->b<p>c</i></b></p></p>", "ab\nc"),
])
def test_odd_pages(page, want):
    assert html.main_text(f"<html><body>{page}</body></html>") == want


def test_very_deep_and_long_pages(spark):
    deep = "<div>" * 50_000 + "<p>bottom" + "</x>" * 50_000
    long = "<article>" + "<p>word one</p>" * 50_000 + "</article>"
    rows = [(1, "http://h.example/", deep, "x"), (2, "http://h.example/", long, "y"), (2, "http://h.example/", long, "y"), (3, None, None, "z"), (None, "no url", "<p>t", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("hashes", F.lit(1))
    got = sorted((r.page_id or 0, len(r.text), r.n_template) for r in html.extract(df).collect())
    assert got == [(0, 1, 0), (1, 6, 0), (2, 50_000 * 9 - 1, 0), (2, 50_000 * 9 - 1, 0), (3, 0, 0)]
