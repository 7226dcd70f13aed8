"""Main text of pages against pages that were built from known texts, broken markup and random bytes."""

import html
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import html_extract as he
from ledgerlens.llm.common import table

PAGES = "page_id bigint, url string, html string, text string, __main int, lang string"
BAD = [
    '<header class="site"><h2>{}</h2><nav><ul><li><a href="/a">{}</a></li></ul></nav></header>',
    "<aside><h3>{}</h3><p>{}</p></aside>",
    '<div class="cookie-notice"><p>{} {}</p></div>',
    '<div id="ad-slot-3" class="ad">{}<p>{}</p></div>',
    '<form action="/x"><label>{}</label><input value="v"><textarea>{}</textarea></form>',
    '<section id="comments"><h3>{}</h3><article class="comment"><p>{}</p></article></section>',
    '<div class="sidebar"><ul><li>{}<li>{}</ul></div>',
    "<script>var a = '<p>{}</p>'; // {}</script>",
    "<style>.x {{ content: '{}{}' }}</style>",
    "<!-- <p>{}</p> {} -->",
    '<div style="display: none"><p>{}</p>{}</div>',
    "<footer><p>&copy; {}</p>{}</footer>",
]


def words(r, low, high):
    return " ".join(r.choice(["alpha", "Beta,", "gamma.", "x<y", "R&D", "é", '"q"', "5 > 4"]) + str(r.randrange(99)) for _ in range(r.randrange(low, high)))


def built(seed):
    """(a page, its main text)"""
    r = random.Random(seed)
    bad = lambda n: "".join(b.format(html.escape(words(r, 1, 30)).replace("'", ""), html.escape(words(r, 1, 12)).replace("'", "")) for b in r.choices(BAD, k=n))
    title, parts = words(r, 2, 8), [words(r, 1, 120) for _ in range(r.randrange(1, 9))]
    blocks = [r.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b>\n", "<div>{}</div>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>\n {} </blockquote>"]).format(html.escape(p).replace(" ", r.choice([" ", "  ", "\n"]))) for p in parts]
    inside = "".join(b + (bad(1) if r.random() < 0.3 else "") for b in blocks)
    article = f"<article><h1>{html.escape(title)}</h1>{inside}</article>"
    main = r.choice(["{}", "<main>{}</main>", '<div class="wrap has-sidebar">{}</div>']).format(article)
    page = f'<!DOCTYPE html><html lang="en"><head><title>{html.escape(title)}</title></head><body>{bad(3)}{main}{bad(3)}'
    return page + r.choice(["", "</body></html>"]), " ".join([title, *parts])


@pytest.mark.parametrize("seed", range(150))
def test_built_pages(seed):
    page, text = built(seed)
    assert he.main_text(page) == text


def test_pages_without_an_article():
    long = "This is a paragraph of some length with words that say little but fill its line well."
    body = f'<div id="top"><a href="a">Home</a> <a href="b">News of today</a></div><div><h1>Head</h1><p>{long}</p><p>Hm.</p><p>{long} Again.</p></div><div><a>one more link</a><a>and one</a></div><p>Copyright 2020 by us</p>'
    assert he.main_text(body) == f"Head {long} Hm. {long} Again."
    assert he.main_text(f"<table><tr><td><a>x</a></td><td class=content><p>{long}</td></table>") == long
    assert he.main_text("only text, no tag") == "only text, no tag"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        (" \n", ""),
        ("<article><p>a<br>b <b>c</b>d&nbsp;e</p></article>", "a b cd e"),
        ("<article><p>&amp;amp; &lt;b&gt; &quot &#233; &unknown; &am</p></article>", '&amp; <b> " é &unknown; &am'),
        ("<article><p>one<p>two <span class='ad'>no</span> three<li>four<li>five</article>", "one two three four five"),
        ("<article><p>kept</p><!-- never ends <p>x</p>", "kept"),
        ("<article><p>kept</p><p cla", "kept"),
        ("<article><p>kept</p><script>var x = '<p>no</p>'", "kept"),
        ("<article><![if IE]>kept<![endif]> too</article>", "kept too"),
        ("<article></div></span>kept</article></article></p>", "kept"),
        ("<head><title>no</title><p>kept", "kept"),
        ("<article class='comment'><p>no</p></article><article><h1>kept</h1></article>", "kept"),
        ("<body class='has-sidebar no-comments'><article><p>kept</article>", "kept"),
        ("<nav><p>no</nav><footer>no", ""),
    ],
)
def test_single_pages(page, text):
    assert he.main_text(page) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<", ">", "<!", "<![x", "<!--", "-->", "&", "&#x", "<a href='", "'", '"', "</", "<script>", "</script>", "text ", "\0", "<article>", "</article>", "<td>", "<svg/>", "<?x"]), max_size=30).map("".join) | st.text(max_size=60))
def test_any_string_has_a_text(page):
    text = he.main_text(page)
    assert text == " ".join(text.split())


@pytest.mark.parametrize("page", ["<b>" * 40_000 + "<li>x" * 20_000, "<div>" * 40_000 + "x", "<article>" * 40_000 + "x", "<a" * 200_000, "<!" * 200_000, "&" * 300_000, "<!--" * 100_000, "word " * 600_000])
def test_long_pages_take_linear_time(page):
    began = time.process_time()
    he.main_text(page)
    assert time.process_time() - began < 20


def test_smoothing():
    lines = [he.Line("x" * n, 0, 2, False, (), 0) for n in (0, 100, 100, 100, 0)] + [he.Line("y" * 500, 0, 1, True, (), 0)]
    ratios = [0, *[np.log2(51)] * 3, 0, 0]
    weights = {k: np.exp(-(k**2) / 2) for k in range(-2, 3)}
    want = [sum(ratios[i + k] * w for k, w in weights.items() if 0 <= i + k < 6) / sum(w for k, w in weights.items() if 0 <= i + k < 6) for i in range(6)]
    assert np.allclose(he.smoothed(lines), want)


def test_columns_and_rows(spark):
    rows = [(1, "u", "<article>a</article>", "old", 1, "x"), (None, None, None, None, None, None), (1, "u", "<article>a</article>", "old", 1, "x")]
    got = he.extract(spark.createDataFrame(rows, PAGES))
    assert got.columns == ["page_id", "url", "html", "__main", "lang", "text", "n_chars"]
    assert sorted((r["text"], r["n_chars"]) for r in got.collect()) == [("", 0), ("a", 1), ("a", 1)]
    assert he.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_query_is_the_operator(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: (r.url, he.main_text(r.html)) for r in table(spark, sf, "pages").collect()}
    assert {r.page_id: (r.url, r.text) for r in he.op11_html_extract(spark, sf).collect()} == pages
