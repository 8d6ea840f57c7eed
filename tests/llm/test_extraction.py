import html
import re
import time

import pytest
from llm_fixtures import TABLES

from traitloom.llm.extraction import extract_main_text, main_blocks

LONG = "A sentence of the article, with some commas, and an end. " * 4


def plain_article(page):
    """What a reader of these pages takes: the article element's blocks, by patterns."""
    inner = re.search(r"<article>(.*?)(</article>|<footer|$)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", inner[1].replace("<br>", " ")) if inner else []
    found = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in parts]
    return "\n".join(filter(None, found))


def test_whole_table(spark):
    pages = spark.read.parquet(f"{TABLES}/pages.parquet")
    found = {row.page_id: (row.url, row.text, row.n_chars) for row in extract_main_text(pages).collect()}
    for page_id, url, page in pages.select("page_id", "url", "html").collect():
        text = plain_article(page)
        assert found[page_id] == (url, text, len(text))


def test_article_without_an_article_element():
    page = f"""<html><head><title>T</title></head><body>
    <div id="top"><div class="site-nav"><a href=x>Home</a> <a href=y>News</a></div></div>
    <div class="cookie-consent">We use cookies, really, on this site, and you must agree to that now.</div>
    <div id="wrap"><div class="story"><h2>The &eacute;nd</h2><p>{LONG}<p>Short.
    <p>One <a href=z>linked</a>   word,<br>next&nbsp;line. {LONG}</p><div class="ad">Buy it now!</div>
    <ul><li>first<li>second</ul></div>
    <div class="box"><a href=1>More</a><a href=2>of this</a></div></div>
    <div class="comments"><p>{LONG}</p></div>
    <form><p>Your name</p></form><footer>&copy; 2020</footer></body></html>"""
    long = LONG.strip()
    assert main_blocks(page) == ["The énd", long, "Short.", f"One linked word, next line. {long}", "first", "second"]


def test_article_with_header_notices_and_comments():
    page = f"""<body><header><h1>Site</h1><p>{LONG}</p></header><main><article><header><h1>Title</h1>
    <span>by someone</span></header><p>{LONG}</p><aside>{LONG}</aside><script>var a = "<p>x</p>";</script>
    <p>{LONG}<span class="ad">ad</span>end</p><p style="display: none">{LONG}</p>
    <section id="comments"><article><p>{LONG}</p></article></section></article></main></body>"""
    long = LONG.strip()
    assert main_blocks(page) == ["Title", long, f"{long} end"]


@pytest.mark.parametrize("page", [None, "", "   ", "<nav>a</nav>", "<html><script>x", "<!-- a", "<", "</p></div>"])
def test_nothing_to_extract(page):
    assert [x for x in main_blocks(page) if x not in ("<",)] == []


@pytest.mark.parametrize("opened, closed", [
    ('<div class="content no-sidebar">', "</div>"), ('<article class="post has-comments">', "</article>"),
    ('<form id="aspnetForm">', "</form>"), ('<div class="widget"><section id="share">', "</section></div>"),
])
def test_a_sign_does_not_take_the_article_away(opened, closed):
    comments = f'<div class="comments"><p>{LONG}</p></div>'
    page = f"""<body>{opened}<div class="article-header"><h1>Title</h1></div><p>{LONG}</p><p>{LONG}</p>
    <div class="share">Share it</div><p>{LONG}<span class="ad">ad</span></p>{closed}<div class="search">Find</div>{comments}</body>"""
    assert main_blocks(page) == ["Title", *[LONG.strip()] * 3]


@pytest.mark.parametrize("before", [
    "<script><!-- var a = 1;</script>", "<script>var a = '<!--';</script>", '<p title="<!--"></p>', "<!-- a --!>", "<!-->",
    "<style><!-- p {} </style>",
])
def test_comment_signs_that_open_no_comment(before):
    assert main_blocks(f"<body>{before}<article><p>{LONG}</p></article></body>") == [LONG.strip()]


def test_markup_that_the_end_cuts_off():
    assert main_blocks("<p>a</p><p>b<!-- c <p>d</p>") == ["a", "b"]
    assert main_blocks("<p>a</p><p>b<a href='x") == ["a", "b"]
    assert main_blocks("<p>a</p><script>if (1 <b") == ["a"]
    assert main_blocks("<p>1 < 2</p>x <") == ["1 < 2", "x <"]


def test_title_lead_and_short_sections_beside_the_container():
    """What says as much as the container, or leads up to it, is kept without an article element, too."""
    long = LONG.strip()
    page = f"""<body><div class="menu"><a href=x>Home</a></div><h1>Title</h1><p>{LONG}</p>
    <div class="content">{f"<p>{LONG}</p>" * 12}</div><div class="box"><a href=1>More</a></div></body>"""
    assert main_blocks(page) == ["Title", *[long] * 13]
    page = f"<body><section><h2>A</h2>{f'<p>{LONG}</p>' * 12}</section><section><h2>B</h2><p>{LONG}</p></section></body>"
    assert main_blocks(page) == ["A", *[long] * 12, "B", long]


def test_deep_pages_take_no_square_of_time():
    assert main_blocks("<div>w " * 2000) == ["w"] * 2000
    start = time.process_time()
    assert len(main_blocks("<div class='a'>w </i>" * 20_000 + "</p>" * 20_000)) == 20_000
    assert len(main_blocks("<div class='share'>w " * 20_000)) == 6667  # as far in as an element holds two thirds
    assert time.process_time() - start < 20


def test_plain_text_and_misnested_tags():
    assert main_blocks("just words &amp; more") == ["just words & more"]
    assert main_blocks("<p><b>a<p>b</b></div>c") == ["a", "b", "c"]
    assert main_blocks("<div><p>" + "x " * 50_000 + "</p></div>") == ["x " * 49_999 + "x"]


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    rows = [(1, None, None), (None, "u", "<p>a</p>"), (2, "v", "<p>b</p>"), (2, "v", "<p>b</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    found = sorted(map(tuple, extract_main_text(pages).collect()), key=repr)
    assert found == [(1, None, "", 0), (2, "v", "b", 1), (2, "v", "b", 1), (None, "u", "a", 1)]
    assert extract_main_text(pages.limit(0)).count() == 0
