import random
import re
import time
from html import unescape
from itertools import product

import pyarrow.parquet as pq
import pytest

from orebody.llm import html_extract as hx

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="home">
<header class="site-header"><a href="/">Site</a><p>The slogan of this site is long and has many many words in it, so it looks like text.</p></header>
<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice"><p>We use cookies to make this site work and you may accept them all or not at all, thanks.</p></div>
<article><header><h1>A  title &lt;here&gt;</h1></header><p>First para <b>bold <i>it</b> a&nbsp;b
next<br>line.<p>Short.</p><div class="ad"><p>Buy now this great thing that you always wanted, it is cheap and good.</p></div>
<ul><li>item one</li><li>item <a href="x">two</a></li></ul><table><tr><td>c1<td>c2</table><blockquote>Quote &#8220;q&#8221;</blockquote>
<form><label>Name</label><input name=x><button>Send it</button></form>
<section id="comments"><h2>Comments</h2><p>Reader one says that this is a very good article and he liked it a lot.</p></section></article>
<aside><p>Related reading of many words that goes on and on for quite some time here.</p></aside>
<footer>&copy; site &middot; words words words. All rights reserved by the owners of the site.</footer></body></html>"""


def test_page_with_everything():
    assert hx.main_text(PAGE).split("\n") == [
        "A title <here>", "First para bold it a b next line.", "Short.", "item one", "item two", "c1", "c2", "Quote “q”",
    ]


def test_page_without_article():
    para = "This is a paragraph of the text, and it has more than fifteen words in it, as prose does."
    page = f"<body><div class=menu><a href=1>Home</a> <a href=2>About</a></div><div id=main><h2>Head line</h2><p>{para}<p>{para}</div><div class=footer><p>{para}</div>"
    assert hx.main_text(page) == f"Head line\n{para}\n{para}"
    assert hx.main_text(f"<p>{para}") == para


def test_cues_in_classes():
    para = "This is a paragraph of the text, and it has more than fifteen words in it, as prose does."
    outside = "".join(f'<div class="{c}"><p>{para}</p></div>' for c in ("header", "page-header", "comment-list", "ad slot", "sidebar", "cookie_bar notice", "footer-links"))
    inside = "".join(f'<div class="{c}"><p>{c} words</p></div>' for c in ("header", "content-box", "adult", "story"))
    assert hx.main_text(f"{outside}<article>{inside}</article>{outside}").split("\n") == ["header words", "content-box words", "adult words", "story words"]


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!--", "<script>x", "</p></div>", "<nav><p>x", "<article></article>", "&amp", "<a<b>"])
def test_broken_pages(page):
    assert isinstance(hx.main_text(page), str)


def test_long_page():
    page = "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>"
    assert hx.main_text(page) == "\n".join(["word & word"] * 50_000)


def energy(scores, arcs, label):
    return sum(max(s, 0) for s, x in zip(scores, label, strict=True) if not x) + sum(max(-s, 0) for s, x in zip(scores, label, strict=True) if x) + sum(w for (a, b), w in arcs.items() if label[a] != label[b])


def test_cut_is_minimal():
    rng = random.Random(9)
    for _ in range(150):
        n = rng.randrange(1, 9)
        scores = [rng.choice([rng.uniform(-2, 2), 0.0, 1.0, -1.0]) for _ in range(n)]
        arcs = {(a, b): rng.choice([0.5, rng.random() * 2]) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        got = energy(scores, arcs, hx.minimum_cut(scores, arcs))
        assert got == pytest.approx(min(energy(scores, arcs, x) for x in product((True, False), repeat=n)))


def test_smoothness_changes_a_label():
    scores, arcs = [3.0, -0.4, 3.0], {(0, 1): 0.5, (1, 2): 0.5}
    assert hx.minimum_cut(scores, arcs) == [True, True, True]
    assert hx.minimum_cut(scores, {}) == [True, False, True]


def test_given_pages_equal_their_articles(spark):
    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    df = spark.createDataFrame([(r["page_id"], r["url"], r["html"]) for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in hx.extract(df).collect()}
    for r in rows:
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)


def test_rows_and_columns_stay(spark):
    df = spark.createDataFrame([(1, None, "u", 5), (1, None, "u", 5), (None, "<article>x", None, 6)], "page_id long, html string, url string, n_chars int")
    out = hx.extract(df)
    assert out.columns == ["page_id", "url", "n_chars", "text"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "u", 5, ""), (1, "u", 5, ""), (None, None, 6, "x")], key=str)
    assert hx.extract(df.limit(0)).count() == 0


def test_attributes_are_read_by_name():
    para = "This is a paragraph of the text, and it has more than fifteen words in it, as prose does."
    layout = (
        'style="overflow:hidden"', 'style="overflow: hidden; color: red"', 'data-id="footer"', 'data-role=menu', 'class="overflow-hidden"', 'class="hidden-xs row"',
        "title='the id=footer hidden class=ad'", 'data-hidden', "data-x='class=\"ad\"'", 'style="display:none;display:block"', 'aria-hidden="false"', 'aria-label="hidden"',
    )
    unseen = ("hidden", "HIDDEN=''", 'aria-hidden="true"', 'style="color:red; DISPLAY : none !important"', "style=visibility:hidden", 'class="row hidden"', 'class="is-hidden"', "data-a=b id=footer", 'class="a"id="ad"')
    for attrs in layout:
        assert hx.main_text(f"<article {attrs}><p>{para}</p></article>") == para, attrs
        assert hx.main_text(f"<article><div {attrs}><p>{para}</p></div></article>") == para, attrs
    for attrs in unseen:
        assert hx.main_text(f"<article><p>{para}</p><div {attrs}><p>Gone. {para}</p></div></article>") == para, attrs
    assert hx.main_text(f'<body style="visibility:hidden"><article><p>{para}</p></article></body>') == para


PARA = "This is a paragraph of the text, and it has more than fifteen words in it, as prose does."
AROUND = '<html><body><header><a href=/>Site</a></header><nav><ul><li><a href=/>Home</a></ul></nav>{}<footer><p>' + PARA + "</p></footer></body></html>"


@pytest.mark.parametrize("open_", [
    '<div class="content has-sidebar">', '<main class="no-sidebar">', '<article class="post hentry category-legal">', '<div class="post tags-politics">',
    '<div class="post comments-open">', '<section id="legal">', '<article><section id="legal">', '<form id="aspnetForm">', '<div class="sidebar-right-layout">', '<div class="page-header-fixed">',
])
def test_one_word_in_a_class_does_not_lose_the_article(open_):
    body = f"<h1>Head line</h1><p>{PARA}</p><p>Short.</p><p>{PARA}</p>"
    assert hx.main_text(AROUND.format(open_ + body)) == f"Head line\n{PARA}\nShort.\n{PARA}"


def test_a_bare_value_may_hold_a_quote():
    assert hx.main_text(f"<article><p data-t=it's>{PARA}</p><p>{PARA}</p></article>") == f"{PARA}\n{PARA}"
    assert hx.main_text(f"<article><a title='a > b' href=x>{PARA}</a></article>") == PARA


def test_readers_comments_go_however_long_they_are():
    talk = '<div id="comments">' + f'<article class="comment"><p>{PARA}</p></article>' * 40 + "</div>"
    for page in (f"<article><h1>Head</h1><p>{PARA}</p>{talk}</article>", f"<article><h1>Head</h1><p>{PARA}</p></article>{talk}", f"<div><h1>Head</h1><p>{PARA}</p></div>{talk}"):
        assert hx.main_text(AROUND.format(page)) == f"Head\n{PARA}"


def test_neighbours_outvote_a_doubtful_class_but_not_a_plain_one():
    page = "<article><h1>Head</h1>" + "<p>{0}</p><p>{0}</p><p class={1}>Odd. {0}</p><p>{0}</p><p>{0}</p></article>"
    assert "Odd." in hx.main_text(page.format(PARA, "share"))
    assert "Odd." not in hx.main_text(page.format(PARA, "ad"))


def test_the_cut_decides_on_given_pages():
    changed = flows = 0
    for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist():
        blocks, elements = hx.blocks_of(r["html"])
        scores = [hx.block_score(b) for b in blocks]
        hx.settle_cues(blocks, scores, elements)
        nodes, arcs = hx.graph(blocks)
        labels = hx.minimum_cut(nodes, arcs)
        changed += sum((s > 0) != x for s, x in zip(scores, labels, strict=False))
        near = [{} for _ in nodes]
        for (a, b), w in arcs.items():
            near[a][b] = near[b][a] = near[a].get(b, 0.0) + w
        assert hx.max_flow(list(range(len(nodes))), nodes, near) == labels
        flows += 1
    assert changed >= flows


def test_unclosed_and_unmatched_tags_take_linear_time():
    began = time.time()
    hx.main_text("<div>" * 20_000 + "<p>x" * 20_000)
    hx.main_text("<b>" * 20_000 + "<p>x</i>" * 20_000)
    hx.main_text("<p>word &amp; word</p><li><a href=x>link</a>" * 20_000)
    assert time.time() - began < 30
