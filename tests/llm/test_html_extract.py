from __future__ import annotations

import html
import re

import numpy as np
import pytest

from alphaspark.llm.boosting import fit_forest
from alphaspark.llm.html_extract import BOILERPLATE, CONTENT, MIXED, blocks_of, decode_tree, extract, extract_pages, node_features, parse, trained
from alphaspark.llm.page_maker import make_page

PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>More links</a></li></ul></nav>
<header><a href=/>Site name</a></header><!-- note --><div class="ad">Buy these shoes now.</div>
<article><h1>The title &amp; more</h1><p>First   paragraph with <b>bold</b> words,
over two lines. It goes on for a while, as articles do.</p><p>Second &#8212; paragraph<br>after a break. It has a sentence more.
<p>Unclosed third paragraph, which also has some words in it.<div class="share"><a href=x>Tweet</a> <a href=y>Like</a></div></article>
<aside class="sidebar"><p>Popular posts</p></aside><div id="comments"><p>I disagree with all of this.</p></div><form><input name=q>Search the site</form><footer>&copy; Site</footer></body></html>"""


def test_a_page():
    assert extract([PAGE], trained()) == ["The title & more\nFirst paragraph with bold words, over two lines. It goes on for a while, as articles do.\nSecond — paragraph after a break. It has a sentence more.\nUnclosed third paragraph, which also has some words in it."]


def test_made_up_pages_that_were_not_trained_on():
    r = np.random.default_rng(77)
    forest, right, many = trained(), 0, 120
    for _ in range(many):
        root = parse(make_page(r))
        nodes, f = node_features(root)
        truth: dict[int, int] = {}
        for x in nodes:
            truth[id(x)] = {"c": CONTENT, "b": BOILERPLATE, "m": MIXED}[x.mark] if x.mark in ("c", "b", "m") else truth[id(x.up)] if x.up else MIXED
        right += blocks_of(root, truth) == blocks_of(root, decode_tree(nodes, forest.log_shares(f)))
    assert right >= 0.85 * many


def test_every_page_of_the_table(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_pages(rows).collect()}
    for r in rows.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in parts if x)
        assert got[r["page_id"]] == (want, len(want))


def test_decoding_has_no_contradictions():
    r = np.random.default_rng(3)
    for _ in range(30):
        nodes, f = node_features(parse(make_page(r)))
        state = decode_tree(nodes, r.normal(size=(len(nodes), 3)))
        for x in nodes:
            if x.up:
                assert state[id(x.up)] != BOILERPLATE or state[id(x)] == BOILERPLATE
                assert state[id(x.up)] != CONTENT or state[id(x)] != MIXED


@pytest.mark.parametrize("page", ["", " ", "plain text", "<", "<p", "<p>a<p>b", "</div></p>", "<div>" * 3000 + "deep" + "</div>" * 3000, "<a <b <c>", "<!-- open", "<script>never closed", "&#x110000; &bogus; &amp", "<table><tr><td>a<tr><td>b</table>", "<p>" + "x" * 500_000])
def test_odd_html_doesnt_crash(page):
    assert isinstance(extract([page], trained())[0], str)


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE), (None, None, PAGE)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = extract_pages(df).collect()
    assert len(got) == 5 and sorted(r["n_chars"] > 0 for r in got) == [False, False, True, True, True]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_pages(df.where("page_id = 9")).count() == 0


def test_forest_learns_and_normalises():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 4)).astype(np.float32)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    forest = fit_forest(x, y, 3, rounds=15)
    shares = forest.log_shares(x)
    assert (shares.argmax(1) == y).mean() > 0.97 and np.allclose(np.exp(shares).sum(1), 1)


ARTICLE = extract([PAGE], trained())[0]


def test_a_head_without_an_end():
    assert extract([PAGE.replace("</head><body>", "").replace("</body></html>", "")], trained()) == [ARTICLE]
    assert [k.tag for k in parse("<head><meta charset=x><title>T</title><p>a</p><p>b").kids] == ["head", "p", "p"]
    assert "loose text" in parse("<head><title>T</title> loose text").kids[-1]


def test_a_form_around_the_page():
    page = PAGE.replace("<form>", "<div class=search>").replace("</form>", "</div>")
    form = page.replace("<body>", '<body><form method="post" action="./x.aspx" id="aspnetForm">').replace("</body>", "</form></body>").replace("</article>", "<select><option>One option</select><button>Send</button></article>")
    assert extract([form], trained()) == [ARTICLE]
    assert extract(["<body><form id=login>Name <input name=n> <button>Send</button></form></body>"], trained()) == [""]


def test_formulas_stay_in_their_line():
    formula = '<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow><annotation encoding="application/x-tex">E=mc^2</annotation></semantics></math>'
    assert extract([PAGE.replace("It goes on for a while", f"It goes on with {formula} for a while")], trained()) == [ARTICLE.replace("It goes on for a while", "It goes on with E=mc2 for a while")]


def in_article(line: str) -> str:
    return extract([PAGE.replace("It goes on for a while", line)], trained())[0]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('It goes<span style="display: none"> secretly</span> on', "It goes on"),
        ("It goes <em hidden>not shown </em>on", "It goes on"),
        ('It goes <b aria-hidden="true">icon</b> on', "It goes on"),
        ('It goes <span class="ad">buy shoes</span> on', "It goes on"),
        ('It goes <small class="sponsored">by a sponsor <b>of note</b></small> on', "It goes on"),
        ('It goes <span class="note">with a note</span> on', "It goes with a note on"),
        ('It <a class="link" href="/x">goes <i>far</i></a> on', "It goes far on"),
    ],
)
def test_elements_of_a_line(line, want):
    assert in_article(line) == ARTICLE.replace("It goes on for a while", want)


#: Pages in the manner of common site builders, and what a reader would call the article.
SITES = {
    "weblog": (
        '<html><head><title>x</title></head><body class="home blog"><div id="page" class="site"><header id="masthead" class="site-header"><h1 class="site-title"><a href="/">The Daily Pear</a></h1><nav class="main-navigation"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header><div id="content" class="site-content"><main id="main"><article class="post hentry"><header class="entry-header"><h1 class="entry-title">Pears are back</h1></header><div class="entry-content"><p>Pears came back this spring, after three dry years. Farmers were glad.</p><p>The <a class="link" href="#">first trees</a> were planted in 1920, by hand.</p><blockquote><p>It was hard work.</p></blockquote></div></article><div id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><p>Nice.</p></li></ol></div></main></div><aside id="secondary" class="widget-area"><section class="widget"><h2>Archives</h2><ul><li><a href="#">May</a></li></ul></section></aside><footer class="site-footer"><div>Proudly powered</div></footer></div></body></html>',
        "Pears are back\nPears came back this spring, after three dry years. Farmers were glad.\nThe first trees were planted in 1920, by hand.\nIt was hard work.",
    ),
    "manual": (
        '<body><div class="navbar"><a href="/">Docs</a> <a href="/api">API</a></div><div class="container"><div class="sidebar"><ul><li><a href=1>Install</a></li><li><a href=2>Use</a></li></ul></div><div class="content" role="main"><h1>Installing</h1><p>Run the installer, then restart. It takes a minute.</p><pre>make all</pre><ul><li>Linux is supported.</li><li>So is BSD.</li></ul><p>Ask for help if it fails, we answer quickly.</p></div></div><div class="footer">Last updated today</div></body>',
        "Installing\nRun the installer, then restart. It takes a minute.\nmake all\nLinux is supported.\nSo is BSD.\nAsk for help if it fails, we answer quickly.",
    ),
    "news": (
        '<body><div class="cookie-consent"><p>We use cookies. <button>OK</button></p></div><div id="top-bar"><a href=/>News</a></div><div class="layout"><div class="story"><h1>Storm hits coast</h1><p class="byline">By <span class="author">A. Writer</span></p><p>A storm hit the coast on Monday, officials said. No one was hurt.</p><div class="ad-slot">Advertisement</div><p>Roads were closed for hours, and trains stopped. Repairs go on.</p><div class="related"><h3>Related</h3><ul><li><a href=1>Old storm</a></li><li><a href=2>Older storm</a></li></ul></div><p>Schools open again on Friday, the mayor said.</p></div><div class="rail"><h4>Most read</h4><ol><li><a href=x>One</a></li><li><a href=x>Two</a></li></ol></div></div><div class="legal">All rights reserved.</div></body>',
        "Storm hits coast\nA storm hit the coast on Monday, officials said. No one was hurt.\nRoads were closed for hours, and trains stopped. Repairs go on.\nSchools open again on Friday, the mayor said.",
    ),
    "bare header": (
        '<body><header><h1>My Site</h1></header><section role="main"><h2>A real title</h2><p>First paragraph of the story, with enough words to be a paragraph. It goes on.</p><p>Second paragraph of the story, also with enough words. And on.</p><h2>Comments</h2><div class="comments"><p>I like it a lot.</p></div></section><footer>Copyright My Site</footer></body>',
        "A real title\nFirst paragraph of the story, with enough words to be a paragraph. It goes on.\nSecond paragraph of the story, also with enough words. And on.",
    ),
}


@pytest.mark.parametrize("site", list(SITES))
def test_pages_that_no_maker_made(site):
    page, want = SITES[site]
    assert extract([page], trained()) == [want]


@pytest.mark.parametrize("page", ["<b>" * 30_000 + "</i>" * 30_000, "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000, "<b>" * 20_000 + "<p>x" * 20_000, "<li>" * 20_000 + "</td>" * 20_000])
def test_stray_tags_take_linear_time(page):
    import time

    start = time.process_time()
    extract([page], trained())
    assert time.process_time() - start < 20
