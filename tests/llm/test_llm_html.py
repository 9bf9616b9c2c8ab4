"""HTML extraction: hand-made pages and all test pages against their articles."""

import html
import re

from ledgerlens.llm import catalog, html_text
from llm_fixtures import SMALL

LONG = ("This is the main text of the page and it has many of the words that are in all of the texts, so that it is "
        "clear to all that it was written for a reader who will be with us to the end of it.")


def test_query_extracts_articles(spark):
    rows = {r["page_id"]: r for r in catalog.op10_html_extraction(spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert rows[p["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert rows[p["page_id"]]["n_chars"] == len(rows[p["page_id"]]["text"]) and rows[p["page_id"]]["url"] == p["url"]


def test_parts_that_are_not_main_text():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>{LONG}";</script></head><body>
    <header><h2>Site of the year and all of it</h2></header><nav><ul><li><a href="/a>b">Home</a><li><a href=x>News</ul></nav>
    <div class="cookie-notice"><p>{LONG}</p></div><div id="sidebarLeft"><p>{LONG}</p></div><!-- <p>{LONG}</p> -->
    <article><header><h1>Title &amp; more</h1></header><p>{LONG}<br>second   line</p><p>Short.</p><aside>{LONG}</aside>
    <div class=ad>{LONG}</div><blockquote>Quoted</blockquote><form><p>{LONG}</p><input></form></article>
    <section class="comments"><p>{LONG}</p></section><footer><p>{LONG}</p></footer></body></html>"""
    assert html_text.main_text(page) == f"Title & more\n{LONG} second line\nShort.\nQuoted"


def test_neighbours_decide_where_no_article_is():
    page = (f"<body><div><a href=1>One</a> <a href=2>Two</a></div><p>Near the menu</p><p>x</p><h2>Head</h2><p>{LONG}</p><p>After</p>"
            f"<p>{LONG}</p><div>{'zzz ' * 60}</div></body>")
    # a tie between neighbours goes to content
    assert html_text.main_text(page) == f"x\nHead\n{LONG}\nAfter\n{LONG}"
    blocks = html_text.page_blocks(page)
    assert [b["text"] for b in blocks][:3] == ["One Two", "Near the menu", "x"]
    assert html_text.label_blocks(blocks)[:2] == [False, False] and html_text.label_blocks(blocks)[-1] is False


def test_broken_markup():
    assert html_text.main_text("") == ""
    assert html_text.main_text("a < b & c &lt; d") == "a < b & c < d"
    assert html_text.main_text(f"<p><b>{LONG}<p>next &nbsp; one &#8364;&eacute;<script>x") == f"{LONG}\nnext one €é"
    assert html_text.main_text("<p title='a>b' data-x=\"<p>\">ok</p") .startswith("ok")
    assert html_text.main_text("<div" * 2000) is not None
    assert html_text.main_text("<div>" * 5000 + LONG) == LONG


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", f"<p>{LONG}</p>"), (1, "v", ""), (2, "w", f"<p>{LONG}</p>" * 3000), (2, "w", "<nav>n</nav>")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r["page_id"] or 0, len(r["text"])) for r in html_text.extract(df).collect())
    assert got == sorted([(1, 0), (0, len(LONG)), (1, 0), (2, (len(LONG) + 1) * 3000 - 1), (2, 0)])
    assert html_text.extract(df.limit(0)).count() == 0
