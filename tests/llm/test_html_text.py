import html as entities
import re
import time

import numpy as np
import pytest
from gridloom.llm import html_text
from hypothesis import given, settings
from hypothesis import strategies as st


def _plain(page):
    """The article of the tables' own template, by its tags."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br)>", body)
    return "\n".join(t for t in (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if t)


def test_all_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, _plain(r.html)) for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


LONG = "Several words of a sentence that goes on for a while, as sentences in articles do."
PAGES = {
    "plain": ("Just text &amp; no  tags.", "Just text & no tags."),
    "empty": ("<html><body></body></html>", ""),
    "only a menu": ("<nav><a href='/'>Home</a></nav>", ""),
    "divs": (
        f"<body><div id='top' class='site-header'><h1>Site</h1><p>{LONG}</p></div><div class='navMenu'><ul><li><a>One</a></li></ul></div><div class='wrap'><div class='content'><h2>Title</h2><p>{LONG}</p><p>Yes.</p><div>{LONG}</div></div>"
        f"<div class='side-bar sidebar'>{LONG}</div><div class='comments'><p>{LONG}</p></div></div><div id='footer'>{LONG}</div></body>",
        f"Title\n{LONG}\nYes.\n{LONG}",
    ),
    "sections": (f"<main><h1>T</h1><section><p>{LONG}</p></section><section><p>{LONG}<p>b</section><aside>{LONG}</aside><form><label>Mail</label>{LONG}</form></main>", f"T\n{LONG}\n{LONG}\nb"),
    "notices": (f"<div role='alert'>{LONG}</div><div class='cookie-consent'>{LONG}</div><article><header><h1>T</h1></header><p>{LONG}</p><p hidden>x</p><p style='display: none'>x</p><footer>{LONG}</footer></article><script>if (a < b) document.write('<p>x</p>')</script>", f"T\n{LONG}"),
    "form around all": (f"<form id='f'><input><div class='menu'>{LONG}</div><main class='has-sidebar'><h1>T</h1><p>{LONG}</p><form><p>{LONG}</p></form><section class='reader-comments'><p>{LONG}</p></section></main></form>", f"T\n{LONG}"),
    "unclosed": (f"<article><p>One<b> two<p>{LONG}<ul><li>a<li>b</ul>", f"One two\n{LONG}\na\nb"),
    "references": ("<p>a&nbsp;&#98;&lt;c&gt; \n d&eacute;</p>", "a b<c> dé"),
    "inline": (f"<article><p>a<i>b</i>c <a href='x'>d</a>,</p><p>{LONG}</p></article>", f"abc d,\n{LONG}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_other_templates(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == want


def test_smoothing_keeps_sums_of_even_lines():
    assert np.allclose(html_text.smoothed(np.full(9, 3.0)), 3.0)
    assert html_text.smoothed(np.array([0, 0, 9.0, 0, 0])).argmax() == 2


def test_awkward_rows(spark):
    long = "<article>" + f"<p>{LONG}</p>" * 20_000
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>a</p>", None), (3, "u", long, "x"), (3, "u", long, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(html_text.extract(pages).collect(), key=lambda r: str(r.page_id))
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 0), (2, 0), (3, 20_000 * (len(LONG) + 1) - 1), (3, 20_000 * (len(LONG) + 1) - 1), (None, 1)]
    assert html_text.extract(pages.where("false")).count() == 0


NAMED = [f"<article class='post category-social tag-search'><h1>T</h1><p>{LONG}</p></article>", f"<main class='post share-enabled'><h1>T</h1><p>{LONG}</p></main>", f"<div class='elementor-widget-container'><h1>T</h1><p>{LONG}</p></div>", f"<div class='content-widget'><h1>T</h1><p>{LONG}</p></div>"]


@pytest.mark.parametrize("page", NAMED)
def test_generated_names_set_nothing_apart(page):
    assert html_text.main_text(page + f"<div class='widget sidebar'>{LONG}</div>") == f"T\n{LONG}"


SPLIT = {
    "split body": (f"<div id='c'><div class='t'><h1>T</h1></div><div class='a'><p>{LONG}</p><p>{LONG}</p></div><div class='b'><p>{LONG}</p></div></div>", f"T\n{LONG}\n{LONG}\n{LONG}"),
    "lede": (f"<div><p>{LONG}</p><div class='body'><p>{LONG}</p><p>{LONG}</p></div></div>", f"{LONG}\n{LONG}\n{LONG}"),
    "quote": (f"<div><p>{LONG}</p><blockquote><p>{LONG}</p><p>{LONG}</p></blockquote><p>{LONG}</p></div>", f"{LONG}\n{LONG}\n{LONG}\n{LONG}"),
}


@pytest.mark.parametrize("name", SPLIT)
def test_split_articles_stay_whole(name):
    page, want = SPLIT[name]
    assert html_text.main_text(f"<body><nav><a>Home</a></nav>{page}</body>") == want


TAKEN_BACK = {
    "terms of a post": f"<article class='post category-advertising'><h1>T</h1><p>{LONG}</p></article>",
    "own id": f"<div id='content' class='page widget-page'><h1>T</h1><p>{LONG}</p></div>",
    "own class": f"<div class='story search-story'><h1>T</h1><p>{LONG}</p></div>",
    "holds the content": f"<div class='page-widget'><div class='social-x'><h1>T</h1><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></div></div>",
    "menu and pager in a flat body": f"<ul><li><a href='/'>Home</a></li><li><a>About</a></li></ul><h1>T</h1><p>{LONG}</p><p><a>Prev</a> | <a>Next</a></p>",
    "neutral names": f"<div class='x1'><a>Home</a></div><div class='x2'><h1>T</h1><div class='x3'><p>{LONG}</p></div></div><div class='x4'><a>About</a></div>",
}


@pytest.mark.parametrize("name", TAKEN_BACK)
def test_names_are_only_a_hint(name):
    assert html_text.main_text(f"<body>{TAKEN_BACK[name]}</body>") == f"T\n{LONG}"


def test_a_part_named_apart_stays_apart_beside_content():
    page = f"<body><div class='site-search'><p>{LONG}</p><p>{LONG}</p></div><div><h1>T</h1><p>{LONG}</p></div><div class='reader-comments'>{f'<p>{LONG}</p>' * 9}</div></body>"
    assert html_text.main_text(page) == f"T\n{LONG}"
    assert html_text.main_text(f"<body><div class='comments'><p>{LONG}</p></div></body>") == ""


NESTED = ["<b>" * 20_000 + "</i>" * 20_000, "<div>x" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<b>" * 20_000 + "<td></td>" * 20_000, "<b>" * 20_000 + "<p>x</p>" * 20_000, "<span>" * 20_000 + "<nav></nav>" * 20_000, "<div>" * 20_000 + "<header>x</header>" * 20_000, "<div class='page-widget'>x" * 20_000]


@pytest.mark.parametrize("page", NESTED, ids=range(len(NESTED)))
def test_time_is_linear_in_nesting(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 4  # a fifth of a second or so each; squared work takes a minute


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<![new[a]]><p>text", "text"),
        ("<![ 1><p>text", "text"),
        ("<![<p>text", "text"),
        ("<![CDATA[a > b]]><p>text", "text"),
        ("<p>text<!-- a --!> on", "text on"),
        ("<!-->text<!--->, too", "text, too"),
        ("<p>text<!-- <p>no", "text"),
        ("<p>text <b class=", "text"),
        ("<p>text <", "text <"),
        ('<p class="odd>text</p><p>more', "text\nmore"),
        ('<p><svg class="icon"/>text<script src="x"/> on', "text on"),
        ("<script>a < b <p>no", ""),
        ('<script x="odd>a<p>b</p></script><p>text', "text"),
        ("<p>&#xD800;&unknown;&#99999999999;", "�&unknown;�"),
    ],
)
def test_broken_markup(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("piece", ["<a ", "<!--", '<p class="', '<a b="c" ', "<a/", "<![", "</", "</a ", "&#x", '<p class="odd>'])
def test_broken_markup_takes_linear_time(piece):
    began = time.process_time()
    html_text.main_text(piece * 20_000)
    assert time.process_time() - began < 4


@settings(max_examples=300, deadline=None)
@given(st.text("<>/!-[]&#;=\"' apx", max_size=60))
def test_no_markup_is_an_error(html):
    html_text.main_text(html)


NAMES = ["<section id='recommended-settings'>", "<section id='notification-api'>", "<div class='early-alert-systems'>", "<p class='share-price'>", "<p id='login-errors'>", "<section id='comments'><h2>Comments</h2>", "<section id='discussion'><h3>Discussion of results</h3>", "<div class='cookie-recipes'><h2>Cookie recipes</h2>"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("around", ["article", "main", "div class='post'"])
def test_sections_named_by_their_subjects_stay(name, around):
    end, head = f"</{name[1:].split()[0]}>", re.findall(r"<h\d>(.*?)</h\d>", name)
    page = f"<body><nav><a>Menu</a></nav><{around}><h1>T</h1><p>{LONG}</p>{name}{LONG} {LONG}{end}<p>{LONG}</p></{around.split()[0]}><div class='footer'>{LONG}</div></body>"
    assert html_text.main_text(page) == "\n".join(["T", LONG, *head, f"{LONG} {LONG}", LONG])


@pytest.mark.parametrize(
    "part",
    [
        f"<section class='reader-comments'><p>{LONG}</p></section>",
        f"<section id='comments'><h2>Comments</h2><div class='comment'><p>{LONG}</p></div></section>",
        f"<section id='comments'><h2>Comments</h2><p>{LONG}</p><form><textarea></textarea></form></section>",
        f"<div class='related-stories'><a href='1'>{LONG}</a><a href='2'>{LONG}</a></div>",
        f"<div class='newsletter-offer'><p>{LONG}</p><form><input></form></div>",
        f"<div class='sidebar'><p>{LONG}</p></div>",
        f"<ol class='thread'><li><p>{LONG}</p></li><li><p>No.</p></li></ol>",
        f"<h3>3 remarks</h3><ul><li><b>Ann</b> <time>1 May</time><p>{LONG}</p></li><li>Bob, 12:30<p>{LONG}</p><ul><li>Eve wrote:<p>No.</p></li></ul></li></ul>",
    ],
)
def test_what_readers_and_sites_add_goes(part):
    for around in ("article", "main", "div class='content'"):
        page = f"<body><{around}><h1>T</h1><p>{LONG}</p><ul><li>One<li>Two</ul><p>{LONG}</p>{part}</{around.split()[0]}></body>"
        assert html_text.main_text(page) == f"T\n{LONG}\nOne\nTwo\n{LONG}"


def test_lists_that_end_an_article_stay():
    steps = "".join(f"<li><b>Step {i}</b><p>{LONG}</p></li>" for i in range(3))
    want = "\n".join(["T", LONG, *(x for i in range(3) for x in (f"Step {i}", LONG))])
    assert html_text.main_text(f"<article><h1>T</h1><p>{LONG}</p><ol>{steps}</ol></article>") == want


def test_headers_and_formulas_of_the_article():
    for around in ("div class='post'", "div", "section"):
        page = f"<body><header><h1>Site</h1><p>{LONG}</p></header><{around}><header><h1>Title</h1></header><p>{LONG}</p><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math></p></{around.split()[0]}></body>"
        assert html_text.main_text(page) == f"Title\n{LONG}\n{LONG} x=1", around


@pytest.mark.parametrize("broken", ["</", "</ ", "<a </", "</a ", "<", "<p></"])
def test_end_tags_without_end_take_linear_time(broken):
    began = time.perf_counter()
    html_text.main_text(f"<p>{LONG}</p>" + broken * 400_000)
    assert time.perf_counter() - began < 8
