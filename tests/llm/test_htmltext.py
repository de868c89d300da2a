"""The block labeller: gradients against differences, blocks against markup,
pages of the tables against their article, and layouts kept out of training."""

import html
import random
import re

import duckdb
import numpy as np
import pytest

from ledgerlake.llm import htmltext as H

HELD_OUT = [
# wordpress
('''<!doctype html><html><head><title>x</title></head><body class="single single-post postid-12"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">My Blog</a></p><p class="site-description">Just another weblog about things.</p><nav id="site-navigation" class="main-navigation"><ul><li class="menu-item"><a href="/">Home</a></li><li class="menu-item current"><a href="/about">About</a></li></ul></nav></header><div id="content" class="site-content"><div id="primary" class="content-area"><main id="main"><article id="post-12" class="post-12 post type-post"><header class="entry-header"><h1 class="entry-title">Baking bread at home</h1></header><div class="entry-content"><p>Bread needs flour, water, salt &amp; time.</p><p>Mix <b>everything</b> and wait.<br>Then bake it.</p><ul><li>Flour</li><li>Water</li></ul></div></article><div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><div class="comment-content"><p>I tried this recipe yesterday and it was lovely. Thank you so much!</p></div></article></li></ol><div class="comment-respond"><form class="comment-form"><label>Name</label><input><button>Post Comment</button></form></div></div></main></div><div id="secondary" class="widget-area"><aside class="widget widget_recent_entries"><h2>Recent Posts</h2><ul><li><a href="/1">Cake</a></li><li><a href="/2">Pie</a></li></ul></aside></div></div><footer class="site-footer"><div class="site-info">Proudly powered by WordPress. All rights reserved.</div></footer></div></body></html>''',
 'Baking bread at home Bread needs flour, water, salt & time. Mix everything and wait. Then bake it. Flour Water'),
# div soup news
('''<html><body><div id="hd"><div class="topnav"><a href="/">News</a> <a href="/s">Sport</a> <a href="/w">Weather</a></div></div><div class="cookie-consent-banner">We use cookies to improve your experience. By continuing you accept our policy.</div><div class="container"><div class="row"><div class="col-md-8"><h1>River floods the old town</h1><div class="story-body"><p>The river rose overnight and flooded several streets in the old town.</p><div class="ad-slot-inline">Buy the best boots today. They keep you dry.</div><p>Nobody was hurt, officials said on Monday.</p><p>More rain is expected.</p></div></div><div class="col-md-4 sidebar"><h3>Most read</h3><ul><li><a href="/a">Ten tips for rain</a></li><li><a href="/b">Bridge closed</a></li></ul></div></div></div><div class="newsletter-signup"><form><p>Get our newsletter every morning.</p><input><button>Subscribe</button></form></div><div id="ft" class="footer-links"><a href="/p">Privacy</a><a href="/t">Terms</a><p>Copyright 2024 The Daily. No part may be reproduced.</p></div></body></html>''',
 'River floods the old town The river rose overnight and flooded several streets in the old town. Nobody was hurt, officials said on Monday. More rain is expected.'),
# table layout
('''<HTML><BODY><TABLE WIDTH=100%><TR><TD COLSPAN=2 CLASS=header><A HREF="/">Old Site</A></TD></TR><TR><TD CLASS=menu><A HREF=a.html>One</A><BR><A HREF=b.html>Two</A></TD><TD CLASS=content><H2>A history of clocks</H2><P>Clocks were first made of water and sand.<P>Later they had wheels and weights.</TD></TR><TR><TD COLSPAN=2 CLASS=footer>Copyright 1999 by the webmaster. Best viewed at 800x600.</TD></TR></TABLE></BODY></HTML>''',
 'A history of clocks Clocks were first made of water and sand. Later they had wheels and weights.'),
# main with sections, sections
('''<!doctype html><html lang=de><body><header><a href="/">Startseite</a><form class="search-form"><input><button>Suche</button></form></header><main><h1>Die Mühle am Bach</h1><p>Die alte Mühle steht seit hundert Jahren am Bach.</p><h2>Geschichte</h2><p>Sie wurde von drei Brüdern gebaut&nbsp;und oft erneuert.</p><aside class="related-articles"><p>Lesen Sie auch: Der Turm im Wald.</p></aside><blockquote>Ohne Wasser kein Mehl.</blockquote></main><section id="kommentare" class="comments"><p>Sehr schöner Text, vielen Dank dafür.</p><p>Ich war als Kind oft dort.</p></section><footer><p>Impressum Datenschutz Kontakt</p></footer></body></html>''',
 'Die Mühle am Bach Die alte Mühle steht seit hundert Jahren am Bach. Geschichte Sie wurde von drei Brüdern gebaut und oft erneuert. Ohne Wasser kein Mehl.'),
# plain
('<p>Only a paragraph here, and nothing else.</p><p>And a second one.</p>','Only a paragraph here, and nothing else. And a second one.'),
('Just plain text without any tags at all.','Just plain text without any tags at all.'),
# article like the tables but with comments
('''<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>t</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="notice">Please accept our new terms. They apply from today.</div><article><h1>Thon re and</h1><p>Thon re and the on. Er the.</p><p>In.</p></article><section class="comments"><div class="comment"><p>And re the on er. The in.</p></div></section><aside class="sidebar"><p>Er the on and re. The thon.</p></aside><form action="/x"><p>Re the on?</p><input type="text"></form><footer>&copy; x &middot; The on.</footer></body></html>''',
 'Thon re and Thon re and the on. Er the. In.'),
('''<body><div class="wrap"><div class="hdr"><span class="logo">Shop</span></div><div id="cookiebar"><p>This site stores data on your device.</p></div><div class="post-body"><h1>Review of a lamp</h1><p>The lamp is bright and small.</p><p>It costs little.</p></div><div class="reader-responses"><div class="response"><p>I own one too and it broke after a week.</p></div><div class="response"><p>Mine works well, I use it daily.</p></div></div><div class="advertising"><p>Lamps for every home, now cheaper.</p></div></div></body>''',
 'Review of a lamp The lamp is bright and small. It costs little.'),
]


@pytest.fixture(scope="module")
def model():
    return H.trained()


def article(page):
    """Text of the generated tables' pages: everything in the article element."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S).group(1)
    return " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(?:p|h1|br)>", " ", inner))).split())


def test_whole_table_equals_the_articles(spark):
    pages = duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    got = H.op12_recurrent_html(spark, "/root/testdata/sf0.01")
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = sorted((i, u, article(h), len(article(h))) for i, u, h in pages)
    same = sum(a == b for a, b in zip(sorted(map(tuple, got.collect())), want))
    assert same >= 0.99 * len(want)


def test_layouts_kept_out_of_training(model):
    got = H.main_texts([page for page, _ in HELD_OUT], model)
    assert got == [want for _, want in HELD_OUT]


def test_held_out_accuracy(model):
    rng = random.Random(1234)
    pages = [p for p in (H.labelled(H.sample_page(rng)) for _ in range(250)) if p[0]]
    p = np.concatenate([H.scores(H.Features([b]), model) for b, _ in pages]) >= 0.5
    y = np.concatenate([labels for _, labels in pages]) > 0
    assert (p == y).mean() > 0.98 and y[p].mean() > 0.96 and p[y].mean() > 0.97


def test_gradients_by_differences():
    rng = random.Random(3)
    pages = [p for p in (H.labelled(H.sample_page(rng)) for _ in range(3)) if p[0]]
    features, labels = H.Features([b for b, _ in pages]), np.concatenate([y for _, y in pages])
    model = {k: v.astype(np.float64) for k, v in H.initial(np.random.default_rng(1)).items()}
    grads, _ = H.gradients(features, labels, model)
    pick = np.random.default_rng(2)
    for name, value in model.items():
        live = np.flatnonzero(grads[name].ravel()) if name in ("path", "word") else np.arange(value.size)
        for at in pick.choice(live, 4):
            old, step, losses = value.ravel()[at], 1e-4, []
            for change in (step, -step):
                value.ravel()[at] = old + change
                losses.append(H.gradients(features, labels, model)[1])
            value.ravel()[at] = old
            assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(grads[name].ravel()[at], rel=0.03, abs=3e-5)


def test_batches_do_not_change_scores(model):
    rng = random.Random(8)
    pages = [H.blocks(H.sample_page(rng).replace(H.MARK, "")) for _ in range(20)]
    pages = [p for p in pages if p]
    alone = np.concatenate([H.scores(H.Features([p]), model) for p in pages])
    assert np.allclose(alone, H.scores(H.Features(pages), model), atol=1e-4)


@pytest.mark.parametrize("page,want", [
    ("<p>a<p>b</p>c", ["a", "b", "c"]),
    ("<p>one <b>two</b>three<br>four &amp; five&nbsp;six</p>", ["one twothree four & five six"]),
    ("<script>if (a < b) { x = '<p>no</p>' }</script><p>yes", ["yes"]),
    ("<!-- <p>no</p> --><div>yes</div><!-- never closed <p>no", ["yes"]),
    ("<style>p > b {}</style><ul><li>x<li>y</ul>z", ["x", "y", "z"]),
    ('<p title="a > b">kept</p><p title="open>rest', ["kept", "rest"]),
    ("a < b and c", ["a < b and c"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("</div></p>lone", ["lone"]), ("", []), ("   \n", []), ("<p></p>", []),
    ("<head><title>t</title></head><body>x", ["x"]), ("&#x41;&eacute;&unknown;", ["Aé&unknown;"]),
])
def test_blocks(page, want):
    assert [b.text for b in H.blocks(page)] == want


ROWS = [(1, "u", None, "a", 1), (2, None, "", "a", 2), (None, "u", "<nav><a>x</a></nav>", None, None), (3, "u", "<article><p>One two three. Four.</p></article>", "z", 3),
        (3, "u", "<article><p>One two three. Four.</p></article>", "z", 3), (4, "u", "<article>" + "<p>Line of words here.</p>" * 20_000 + "</article>", None, 4),
        (5, "u", "<div>" * 3000 + "deep words stand here." + "</div>" * 10, None, 5), (6, "u", "<" * 5000, None, 6), (7, "u", "<p>" + "word " * 100_000 + ".", "q", 7)]


@pytest.mark.parametrize("full", [True, False])
def test_edges(spark, tmp_path, full):
    spark.createDataFrame(ROWS if full else [], "page_id long, url string, html string, text string, n_chars long").write.parquet(f"{tmp_path}/pages.parquet")
    got = H.op12_recurrent_html(spark, str(tmp_path)).collect()
    assert len(got) == (len(ROWS) if full else 0)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    if full:
        by = {r["page_id"]: r for r in got}
        assert by[1]["text"] == by[2]["text"] == "" and by[None]["text"] == "" and by[3]["text"] == "One two three. Four."
        assert by[4]["n_chars"] == 20 * 20_000 - 1 and by[7]["n_chars"] == 500_001  # whole texts
