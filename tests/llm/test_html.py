"""Main text of pages: against another reading of the given pages, planted boilerplate, and odd pages."""

import html
import random
import re

import pytest

from tidebar.llm import htmltext
from tidebar.llm.htmltext import Template, main_text


def alone(page: str) -> str:
    return main_text(page, Template())


def test_given_pages_equal_their_articles(spark, sf):
    got = {r["page_id"]: r for r in htmltext.op13_html_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.sub(r"<br>", " ", re.search(r"<article>(.*?)</article>", p["html"], re.S)[1])
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want) and got[p["page_id"]]["url"] == p["url"]


def site(i: int, body: str) -> str:
    """A page whose boilerplate has no telling names."""
    links = "".join(f"<div class=k><a href=/{i}/{j}>Topic {i * 7 + j}</a></div>" for j in range(i % 4 + 2))
    return f"<html><body><div class=q1>{links}</div><div class=q2>We store small files</div><div class=q3><h1>Title {i}</h1>{body}<div class=q4>Tell <b>a friend</b></div></div><div class=q5>All rights reserved</div></body></html>"


def article(i: int, n: int = 4) -> list[str]:
    r = random.Random(i)
    return [" ".join(f"w{r.randrange(500)}" for _ in range(30)) for _ in range(n)]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://Site.example.com/{i}", site(i, "".join(f"<p>{b}</p>" for b in article(i, 2 + i % 3)))) for i in range(12)]
    rows += [(i, f"http://few.example.com/{i}", site(i, "".join(f"<p>{b}</p>" for b in article(i)))) for i in range(20, 23)]
    rows += [(i, f"http://copies.example.com/{i}", f"<body><nav>{i}</nav><div class=q3>" + "".join(f"<p>{b}</p>" for b in article(99)) + "</div>") for i in range(30, 40)]
    rows += [(50, None, "<p>no url</p>"), (None, "http://site.example.com/x", None), (51, "http://site.example.com/y", ""), (0, rows[0][1], rows[0][2]), (52, "not a url", "<p>y")]
    return spark.createDataFrame([(*r, "clash", "t") for r in rows], "page_id long, url string, html string, host string, text string").repartition(4).cache()


def test_templates_are_deduced_without_names(pages):
    got: dict = {}
    for r in htmltext.extract(pages).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    for i in range(12):
        assert got[i] == ["\n\n".join([f"Title {i}", *article(i, 2 + i % 3)])] * (2 if i == 0 else 1)
    for i in range(30, 40):  # copies of one article aren't a template
        assert got[i] == ["\n\n".join(article(99))]
    for i in range(20, 23):  # too few pages: only blocks of links go
        assert got[i] == ["\n\n".join(["We store small files", f"Title {i}", *article(i), "Tell a friend", "All rights reserved"])]
    assert got[50] == ["no url"] and got[None] == [""] and got[51] == [""] and got[52] == ["y"]


def test_classes_nest_and_menus_are_found(spark, pages):
    rows = pages.select("page_id", "url", htmltext.F.lower(htmltext.F.regexp_extract("url", "//([^/]*)", 1)).alias("_host"), "html")
    out = {r["host"]: r for r in htmltext.deduce_templates(rows).collect()}
    assert "few.example.com" not in out and "copies.example.com" not in out
    own = out["site.example.com"]
    assert len({e["class"] for e in own["template"]}) >= 2 and own["menus"]


def test_empty_table(spark, pages):
    assert htmltext.extract(pages.where("page_id = -1")).count() == 0


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><h1>T</h1><p>a<p>b <b>c</b><br>d</article>", "T\n\na\n\nb c d"),
        ("<nav>n</nav><main><p>x</p><aside>s</aside><form>f<input></form></main><footer>f</footer>", "x"),
        ("<header><h1>Site</h1></header><article><header class=entry-header><h1>T</h1></header><p>a</p><footer>tags</footer></article>", "T\n\na"),
        ("<div class='with-sidebar'><article><p>a</p></article></div><div id='sidebar'><article>teaser</article></div>", "a"),
        ("<article><p>a</p><section id=comments><article class=comment>c</article></section><div class='ad-slot'>buy</div><div class=cookieNotice>ok?</div></article>", "a"),
        ("<p>a<script>if (x < 1) { '</p>' }</script>b</p><style>p{}</style><noscript>n</noscript><textarea>t</textarea>", "ab"),
        ("<p>x &amp;amp; &lt;b&gt; &#x41;&#66;&nbsp;&eacute &am</p>", "x &amp; <b> AB é &am"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>a<td>b</table><pre>p\n q</pre></article>", "1\n\n2\n\na\n\nb\n\np q"),
        ("<article></article><p>outside</p>", ""),
        ("<p title='hidden' class=x>seen</p><p hidden>not</p><p style='display: none'>not</p><p data-class=nav>yes</p>", "seen\n\nyes"),
        ("<p>a <!-- <p>no</p> --> b</p><!-- rest", "a b"),
        ("<p>a < b and c > d</p><p", "a < b and c > d"),
        ("<a href='/'>Home</a><p>text with <a href=x>a link</a></p>", "text with a link"),
        ("", ""),
        ("plain", "plain"),
    ],
)
def test_odd_pages(page, want):
    assert alone(page) == want


@pytest.mark.parametrize("page", ["<" * 200_000, '<a href="' * 30_000, "<div>" * 30_000 + "x", "<b><p>" * 20_000, "<!--" * 50_000, "&amp;" * 100_000, "</div>" * 50_000, "<script>" * 20_000])
def test_long_odd_pages_take_no_square_of_time(page):
    alone(page)
