"""Main text: the cut against all labellings, and hand-made pages."""

import itertools
import os
import random
import time

import pytest

from helixframe.llm import html_text

LONG = "This sentence belongs to the article and has enough words to look like running prose, which the classifier likes."


def cost_of(labels, costs, links):
    return sum(abs(c) for keep, c in zip(labels, costs) if keep != (c > 0) and c) + sum(w for i, j, w in links if labels[i] != labels[j])


def test_cut_is_minimal():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 9)
        costs = [r.randint(-60, 60) for _ in range(n)]
        links = [(i, j, r.randint(1, 40)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        got = html_text.minimum_cut(costs, links)
        best = min(cost_of(x, costs, links) for x in itertools.product((False, True), repeat=n))
        assert cost_of(got, costs, links) == best


def test_pages():
    text = html_text.main_text
    assert text(None) == text("") == text("   ") == ""
    page = f"""<html><head><title>T</title><script>var a="</p><p>no";</script><style>p{{}}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>{LONG}</p></div>
    <main><article><header><h1>Title &amp; more</h1></header><p>{LONG}</p><p>Short.</p><p>A <b>bold</b><br>word&nbsp; x &#233;</p>
    <div class="ad">{LONG}</div><aside><p>{LONG}</p></aside><ul><li>one</li><li>two</ul>
    <form><p>{LONG}</p></form></article><section id="comments"><p>{LONG}</p><div class="comment-body">{LONG}</div></section></main>
    <div class="sidebar"><div class="widget-content">{LONG}</div></div><footer>&copy; 2024</footer></body></html>"""
    assert text(page) == "\n\n".join(["Title & more", LONG, "Short.", "A bold word x é", "one", "two"])


def test_without_article():
    page = f'<body><div id="menu"><a href="a">a</a> <a href="b">b</a></div><div id="content"><h2>Head</h2><p>{LONG}<p>{LONG}<p>Yes.<p>{LONG}</div><div class="footer">bye</div>'
    assert html_text.main_text(page) == "\n\n".join(["Head", LONG, LONG, "Yes.", LONG])
    plain = f"<p>{LONG}</p><p>Short one.</p><p>{LONG}</p><div><a href=x>link</a> <a href=y>link</a></div>"
    assert html_text.main_text(plain) == "\n\n".join([LONG, "Short one.", LONG])


def test_broken_markup():
    text = html_text.main_text
    assert text(f"<article><p>{LONG}<p>a < b and c > d</p>") == f"{LONG}\n\na < b and c > d"
    assert text(f"<article><p>{LONG}</p><script>never ends <p>x") == LONG
    assert text(f"<article><p>{LONG}</p><!-- never ends <p>x") == LONG
    assert text(f'<article><p title="a > b">{LONG}</p></div></span></article>') == LONG
    assert text("<div>" * 30_000 + f"<article><p>{LONG}</p>") == LONG
    assert len(text("<article>" + f"<p>{LONG}</p>" * 5000)) == 5000 * (len(LONG) + 2) - 2


def test_elements_without_end():
    text = html_text.main_text
    for name in ("svg", "option", "select", "object", "noscript", "math", "textarea", "iframe", "template"):
        around = f"<body><div><{name}></div><article><p>{LONG}</p></article>"
        assert text(around) == LONG, name
    for name in ("svg", "option", "datalist", "math"):
        assert text(f"<body><{name}><p>{LONG}</p>") == LONG, name
    assert text(f"<article><p>{LONG}</p><p>So <math><mi>x</mi> = 1</math> it is, <object>plainly</object> said here.</p></article>") == f"{LONG}\n\nSo x = 1 it is, plainly said here."


def test_deep_pages():
    for depth in (10, 1990, 2500, 50_000):
        assert html_text.main_text("<div>" * depth + f"<nav><a href=x>Home</a></nav><p>A short paragraph comes here.</p><p>{LONG}</p>") == f"A short paragraph comes here.\n\n{LONG}"


@pytest.mark.parametrize(
    "page",
    [
        '<a "', "<a '", '<script "', "<a b='", '<a b="c', "<!--", "<textarea>", "<div>", "<b>", "</i>", "<b></i>", "<p><b>", "<p><div>", "<svg><body><b><p></p>", "<li><b>", "<a", "<", "<div></span>",
        "<table><tr><td>", "<a href=x>", "<option>", "&", "<p><div><b><p></p>", "<b><div>x</div>y", "<br>", "</p><",
    ],
)
def test_hostile_markup_takes_linear_time(page):
    began = time.process_time()
    for text in (page * (200_000 // len(page)), page * (100_000 // len(page)) + "x</p>" * 20_000):
        html_text.blocks(text)
    assert time.process_time() - began < 6


def test_neighbours_turn_labels():
    """Short lines that the classifier takes for boilerplate are content among paragraphs, and links stay out."""
    page = f"<article><p>{LONG}</p><p>So it was</p><ul><li>one</li><li>two</li></ul><p>{LONG}</p><ul><li><a href=a>one</a></li></ul></article>"
    found = html_text.blocks(page)
    keep = html_text.minimum_cut(html_text.weigh(found), html_text.edges(found))
    assert [b.cost > 0 for b in found] == [True, True, False, False, True, False]
    assert keep == [True] * 5 + [False]
    table = "<table>" + "<tr><td>1</td><td>x</td></tr>" * 300 + "</table>"
    assert len(html_text.main_text(f"<article><p>{LONG}</p>{table}<p>{LONG}</p></article>").split("\n\n")) == 602


def test_neighbours_turn_labels_on_the_test_pages(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    turned = every = 0
    for row in spark.read.parquet(f"{sf}/pages.parquet").collect():
        found = html_text.blocks(row.html)
        keep = html_text.minimum_cut(html_text.weigh(found), html_text.edges(found))
        turned += sum(k != (b.cost > 0) for k, b in zip(keep, found))
        every += len(found)
        inner = [b for b in found if b.element.mark >= html_text.INSIDE]
        assert all(k for k, b in zip(keep, found) if b.element.mark >= html_text.INSIDE) and inner
    assert 0 < turned < every / 2


def test_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (1, "u", f"<article><p>{LONG}</p></article>", "x"), (None, None, None, "x"), (2, "v", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", LONG, len(LONG))] * 2 + [(0, None, "", 0), (2, "v", "", 0)], key=str)
    assert html_text.extract(df.limit(0)).count() == 0
