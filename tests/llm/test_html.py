import html as entities
import re
import time

import pytest
from pyspark.sql import functions as F

from meshloom.llm import html, layouts


def truth(page):
    """Of the known layout: the article's blocks, cut by regular expressions."""
    m = re.search(r"(?s)<article>(.*?)</article>", page)
    parts = re.split(r"</?(?:p|h1)>", m[1].replace("<br>", " "))
    return "\n".join(t for p in parts if (t := " ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split())))


def test_known_layout_is_extracted_whole(spark, sf):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r.page_id: r for r in html.extracted(pages).collect()}
    rows = pages.collect()
    assert len(out) == len(rows)
    for r in rows:
        assert out[r.page_id].text == truth(r.html) and out[r.page_id].n_chars == len(out[r.page_id].text)


HARD = """<!doctype html><html><head><title>No</title><script>if (a < b) { "</p>" }</script><style>p{}</style>
<body class="page"><header><h1>Site name</h1><nav><a href=/>Home</a> <a href="/a>b">News</a></nav></header>
<div id="cookie-notice">We use cookies on this site to make it better for you and for everyone.</div>
<main><article class="post"><header><h1>Caf&eacute; &amp; co</h1></header><p>First   paragraph with <a href="x">a link</a> in it,
and a second&nbsp;line.<p>Short.<div class="ad-slot">Buy now the best things that money can buy today</div>
<ul><li>one<li>two &lt;three&gt;</ul><aside class="related"><p>Read this other long story about the thing we wrote of yesterday</aside>
<form><label>Mail</label><input name=q><button>Send</button></form>
<p>Last 1 < 2 one.</p><section id="comments"><h3>Comments</h3><p>I liked this article very much, thank you for writing it all down.</p></section></article></main>
<div class="sidebar"><p>A long text in the side bar that says what the site is about and who has made it.</p></div>
<footer>&copy; 2020 <a href="/imprint">Imprint</a></footer></body></html>"""


def test_parts_of_a_page_are_left_out():
    tree = html.default_tree()
    assert html.main_text(HARD, tree) == "Café & co\nFirst paragraph with a link in it, and a second line.\nShort.\none\ntwo <three>\nLast 1 < 2 one."
    plain = "<body><div><a href=1>Home</a></div><div><a href=2>About us</a></div><div>" + "long words here " * 30 + "</div><div>" + "more of it " * 40 + "</div><div><a href=3>Imprint</a></div>"
    assert html.main_text(plain, tree) == ("long words here " * 30).strip() + "\n" + ("more of it " * 40).strip()


def test_blocks_of_held_out_pages_in_every_layout():
    tree = html.default_tree()
    assert len(layouts.LAYOUTS) >= 6
    for layout in layouts.LAYOUTS:
        x, y = html.labelled_blocks(layouts.labelled_pages(99, 30, [layout]))
        got = tree.keep(x)
        precision, recall = (got & y).sum() / got.sum(), (got & y).sum() / y.sum()
        print(layout.__name__, round(precision, 3), round(recall, 3))
        assert precision >= 0.95 and recall >= 0.95, layout.__name__


def test_neighbours_tell_where_no_name_does():
    kinds = {html.FEATURES[f].split()[0] for f, *_ in html.default_tree().nodes if f >= 0}
    assert {"words", "links"} <= kinds
    x, y = html.labelled_blocks(layouts.labelled_pages(7, 30, [layouts.nameless_divs, layouts.table_layout, layouts.breaks_only]))
    flat = x.copy()
    flat[:, [0, 1, 3, 4, 5, 6, 8, 9, 10, 11, 13, 14]] = 0
    tree = html.default_tree()
    assert (tree.keep(x) == y).mean() > (tree.keep(flat) == y).mean()


PROSE = "Some words of the paragraph that go on for a while and say what there is to say about it in plain words for all who read. " * 2


@pytest.mark.parametrize("page", ['<form id="aspnetForm">{}</form>', '<body class="right-sidebar single-post">{}</body>', '<div class="content-with-sidebar">{}</div>', '<article class="post has-comments">{}</article>', '<body class="no-sidebar"><article>{}</article></body>', "<div class=comments-page>{}</div>", "{}"])
def test_names_of_wrappers_drop_nothing(page):
    out = html.main_text(page.format(f"<h1>Its title</h1><p>{PROSE}</p><p>{PROSE} <math><mi>y</mi></math> <object>z</object></p>"), html.default_tree())
    assert out == "\n".join(("Its title", PROSE.strip(), PROSE.strip() + " y z"))


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '\">", "<!--", "<a <b>", "<b>", "<div>", "</x>", "<script>", "&amp", "<", "<p class='", "<head>", "<head><p>", "<script></script", "</script", "<style>x</style"])
def test_malformed_markup_takes_linear_time(piece):
    began = time.time()
    html.main_text(piece * 100_000, html.default_tree())
    assert time.time() - began < 5


def test_edge_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x"), (3, "u", "<"), (3, "u", "<"), (4, "u", "<article><p>" + "word " * 200_000), (5, "u", "<!-- never closed"), (6, "u", "<p a='b"), (7, "u", "<script>x")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").withColumn("n_chars", F.lit("x"))
    out = {r.page_id: r.text for r in html.extracted(pages).collect()}
    assert out[1] == out[2] == out[5] == out[7] == "" and out[None] == "x" and len(out[4]) == 999_999
    assert html.extracted(pages).count() == 9 and html.extracted(pages.limit(0)).count() == 0


def test_part_names_on_wrappers_keep_the_article():
    tree = html.default_tree()
    text = "some words of the article that go on for a while and say what there is to say " * 3
    for wrap in ('<body class="single has-sidebar"><article><p>{}</p></article></body>', '<body><div class="wrapper menu-open"><div class="sidebar"><p>Side words</p></div><article><p>{}</p></article></div></body>', '<body><article class="hentry has-comments"><p>{}</p></article></body>'):
        assert html.main_text(wrap.format(text), tree) == text.strip()
    listed = f'<main><article class="post has-comments"><p>{text}</p></article><div id="comments"><article class="comment"><p>I liked it very much, thank you for all that.</p></article></div></main>'
    assert html.main_text(listed, tree) == text.strip()


COMMENT = "I liked this and want to say that in my view the matter is another, as one sees when one looks at the many cases that were known before. " * 4


@pytest.mark.parametrize("after", ["<div id='comments'><p>{}</p></div>", "<section><h2>What readers say</h2><p>{}</p></section>", "<section><p>{}</p><p>{}</p></section>", "<div><h3>More stories</h3><ul><li><a href=1>One story of it</a><li><a href=2>Another one</a></ul></div><div class=replies><p>{}</p></div>", "<ol class=commentlist><li class=comment><p>{}</p></ol>"])
def test_what_follows_an_article_is_left_out(after):
    tree = html.default_tree()
    body = f"<h1>Its title</h1><p>{PROSE}</p><p>{PROSE}</p>"
    after = after.replace("{}", COMMENT)
    wanted = "\n".join(("Its title", PROSE.strip(), PROSE.strip()))
    assert html.main_text(f"<body><article>{body}</article>{after}</body>", tree) == wanted
    if "commentlist" in after:
        assert html.main_text(f"<body><div>{body}</div>{after}</body>", tree) == wanted


def test_rules_before_the_tree_drop_no_main_text():
    for _, text, kept in layouts.labelled_pages(5, 60):
        page, left = html.Page(text), list(reversed(kept))
        for (block, *_), out in zip(page.blocks, html.outside(page)):
            if left and left[-1] == block:
                left.pop()
                assert not out
