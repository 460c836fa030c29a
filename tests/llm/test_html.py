import html
import re

import numpy as np
import pytest

from mockloom.llm import html as module
from mockloom.llm.html import EMBEDDED, FEATURES, LABELLED, blocks, decide, extract, grow, main_text, table_of, tree

LONG = "Some long paragraph of text that goes on and on for many words in the article body to be kept."


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n".join(x for x in parts if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


@pytest.mark.parametrize(("page", "text"), [
    ("<header><h1>Site</h1><nav><a href=x>Home</a></nav></header><main><h1>T</h1><p>One &lt;b&gt; two&nbsp;x</p><div class='comments'><p>great post</p></div>"
     "<form><label>Mail</label><input></form><ul><li>item</ul></main><aside>side</aside><footer>f</footer>", "T\nOne <b> two x\nitem"),
    (f"<div id=menu><a href=1>Home</a> <a href=2>News</a></div><div class='content'><h2>Title here</h2><p>{LONG}</p><p>Short.</p></div>"
     "<div class=cookie-notice>We use cookies and like them a lot</div>", f"Title here\n{LONG}\nShort."),
    (f"<article><script>var t='</p>';</script><style>p{{}}</style><p>{LONG}<!-- gone --><p>a<br>b  &amp;\n c</article>", f"{LONG}\na b & c"),
    (f"<p>{LONG}</p><p>{LONG}</p><p><a href=1>one</a> <a href=2>two</a></p>", f"{LONG}\n{LONG}"),
    (f"<article><p title='a>b'>{LONG}</p></article><div class=\"related\"><p>{LONG}</p></div>", LONG),
    ("", ""), ("<script>unclosed <p>x", ""), ("<a href=\"", ""), ("<article>a < b</article>", "a < b"),
])
def test_small_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("tag", [
    "<video-js></video-js>", "<svg-icon></svg-icon>", "<select-menu>", "<title-bar></title-bar>", "<svg/>", "<svg class='a' />", "<math/>", "<svg><style/><title/></svg>",
    "<svg><svg></svg>lost</svg>", "<object>a<object>b</object>c</object>", "<video>no <a>player</a></video>", "<noscript>off</noscript>", "<svg><title>icon</title></svg>",
    *[f"<{name}>" for name in sorted(EMBEDDED)], "<select><script>'</select>'</script>", "<title>t</title >", "<script>s</script x>",
])
def test_elements_without_text_end_where_they_should(tag):
    assert main_text(f"<article>{tag}<p>{LONG}</p><p>Last.</p></article>") == f"{LONG}\nLast."
    assert main_text(f"<article>{tag}<p>{LONG}</p><video>x</video><svg>y</svg><select>z</select><title>t</title><p>Last.</p></article>") == f"{LONG}\nLast."


LINKS = "<a href=1>Home page</a> <a href=2>All the news</a> <a href=3>About us</a>"
LONGER = " ".join([LONG] * 5)


@pytest.mark.parametrize("box", ["main-menu", "main-nav", "cookie-content", "newsletter-content", "post-share", "content-top"])
def test_article_in_plain_elements_stays_beside_a_box_with_a_main_word(box):
    for text in (LONG, LONGER):
        assert main_text(f"<div class={box}>{LINKS}</div><div><p>{text}</p><p>{text}</p><p>{text}</p></div>").replace("Home page All the news About us\n", "" if box == "content-top" else "-") == "\n".join([text] * 3)


@pytest.mark.parametrize("box", ["div class=cookie-content", "div class='newsletter-content x'", "div id=post-comments", "article class=comment", "ul class='main nav'"])
def test_side_words_win_in_a_name(box):
    assert main_text(f"<{box}><li>{LONG}</li></{box.split()[0]}><div><p>{LONGER}</p></div>") == LONGER


@pytest.mark.parametrize("start", [
    "section id=side-effects", "section id=search-methods", "section id=legal-status", "div class=side-effects", "h2 id=search", "p class=notice", "div class=entry-header",
    "div class='post category-legal tag-search'", "div class='content has-sidebar'", "div class='elementor-widget elementor-widget-theme-post-content'", "td class=comment", "li data-id=comment",
])
def test_own_sections_stay(start):
    name = start.split()[0]
    assert main_text(f"<article><p>{LONG}</p><{start}>{LONG}</{name}><p>Last.</p></article>") == f"{LONG}\n{LONG}\nLast."


@pytest.mark.parametrize("start", [
    "p class=advert", "li class=comment", "td class=ad", "blockquote class=comment", "h3 class=related-posts", "section id=comments", "div class=related-posts", "x-box class=advert", "p id=advert",
])
def test_side_names_are_read_on_all_blocks(start):
    name = start.split()[0]
    assert main_text(f"<article><p>{LONG}</p><{start}>{LONG}</{name}><p>Last.</p></article>") == f"{LONG}\nLast."


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p class=advert>buy<p>a b c<ul><li class=comment>x<ul><li>y</ul>z<li>d e f</ul>g h</article>", "a b c\nd e f\ng h"),
    ("<article><table><tr><td class=ad>x<td>a b<tr><td>c d</table><h2 class=advert>x<p>e f</article>", "a b\nc d\ne f"),
    ("<article><dl><dt>a<dd class=comment>x<dt>b</dl><div class=ad>x</p></li></td></div>c</article>", "a\nb\nc"),
])
def test_names_hold_to_where_elements_end(page, text):
    assert main_text(page) == text


def test_blocks_know_links():
    assert [(b.words, b.links) for b in blocks("<p>a <a>b c</a> d</p><p>x</p>")] == [(4, 0.5), (1, 0.0)]


def test_nulls_repeats_and_empty_table(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    pages = spark.createDataFrame([(1, None, None, "t", 1), (1, "u", "", "t", 1), (None, "u", f"<main>{LONG}</main>", "t", 1), (2, "u", "<main>" + "<p>w</p>" * 30_000 + "</main>", "t", 1)], schema)
    got = {(r.page_id, r.url): r for r in extract(pages).collect()}
    assert got[1, None].text == "" and got[1, "u"].n_chars == 0 and got[None, "u"].text == LONG and got[2, "u"].n_chars == 59_999
    assert extract(spark.createDataFrame([], schema)).count() == 0


RECIPE = ["Pancakes", "Soft and quick.", "2 eggs", "200 g flour", "300 ml milk", "salt", "Mix all of it in a bowl and let it rest for a while before you bake.", "Then stir."]
RECIPE_PAGE = "<div><h2>{}</h2><p>{}</p><ul><li>{}</li><li>{}</li><li>{}</li><li>{}</li></ul><p>{}</p><p>{}</p></div>".format(*RECIPE)
MENU = "<div><a href=1>Home</a></div><div><a href=2>News of the day</a></div><div><a href=3>About us</a></div>"
CARDS = "<a href=x><h3>Other story</h3><p>Short teaser text here</p></a>" * 3


@pytest.mark.parametrize("page", [RECIPE_PAGE, MENU + RECIPE_PAGE, MENU + RECIPE_PAGE + MENU, RECIPE_PAGE + MENU, MENU + RECIPE_PAGE + MENU + "<p>Imprint and terms</p>", RECIPE_PAGE + CARDS])
def test_short_blocks_of_plain_elements_stay(page):
    assert main_text(page) == "\n".join(RECIPE)


def test_links_go_on_through_blocks():
    assert [b.links for b in blocks(CARDS)] == [1.0] * 6
    assert main_text(f"<article><p>{LONG}</p></article>{CARDS}") == LONG
    assert [b.links for b in blocks("<p><a href=1>open link<p>plain text<p>more")] == [1.0, 0.0, 0.0]
    assert [b.links for b in blocks("<p><a href=1>a<p>b <a href=2>c</a>")] == [1.0, 0.5]


def test_lists_of_links_in_an_article_stay():
    items = "".join(f"<li><a href={k}>Source number {k}</a></li>" for k in range(6))
    assert main_text(f"<article><p>{LONG}</p><h2>Sources</h2><ul>{items}</ul></article>") == "\n".join([LONG, "Sources", *[f"Source number {k}" for k in range(6)]])


def test_unseen_elements_have_no_text():
    page = "<p>Seen <span hidden>not</span> text <span style='display:none'>no <span>no</span> no</span>end</p><p hidden>gone</p><li style='display: none'>gone</li><p>Last <i hidden>x<p>Seen again"
    assert [b.text for b in blocks(page) if not b.side] == ["Seen text end", "Last", "Seen again"]


def test_neighbours_decide():
    """A short block is kept or goes by its neighbours alone, and the fitted tree looks at them."""
    row = dict(zip(FEATURES, [0, 0, 0.0, 0, 3, 0.0, 5, 0.0, 4, 0.0]))
    verdict = lambda **k: decide(tree(), np.array([(row | k)[f] for f in FEATURES], float))
    assert verdict() and verdict(links_before=1.0) and verdict(links_after=1.0) and not verdict(links_before=1.0, links_after=1.0)
    rows = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    rng, changed = np.random.default_rng(0), 0
    for _ in range(20):
        mixed = rows[:, :-1].copy()
        mixed[:, 6:] = mixed[rng.permutation(len(rows)), 6:]
        changed += sum(decide(tree(), r) != bool(y) for r, y in zip(mixed, rows[:, -1]))
    assert changed > 20


def test_tree_by_a_second_reading():
    """Every split is the best one, found by counting in plain loops, and every labelled block falls into a leaf of its class."""
    rows = [tuple(map(float, line.split())) for line in LABELLED.strip().splitlines()]

    def impurity(part):
        good = sum(r[-1] for r in part)
        return good * (len(part) - good) / len(part) if part else 0.0

    def check(node, part):
        if isinstance(node, bool):
            assert len({r[-1] for r in part}) == 1 and node == bool(part[0][-1])
            return
        gains = {}
        for f in range(len(FEATURES)):
            values = sorted({r[f] for r in part})
            for a, b in zip(values, values[1:]):
                t = (a + b) / 2
                gains[f, t] = impurity(part) - impurity([r for r in part if r[f] <= t]) - impurity([r for r in part if r[f] > t])
        assert gains[node[0], node[1]] >= max(gains.values()) - 1e-9
        check(node[2], [r for r in part if r[node[0]] <= node[1]])
        check(node[3], [r for r in part if r[node[0]] > node[1]])

    check(tree(), rows)
    a = np.array(rows)
    assert grow(a[:, :-1], a[:, -1]) == tree()


def test_verdicts_against_a_walk_by_hand(spark):
    """The blocks of whole pages, classified by reading the tree as nested conditions."""
    def source(node, depth=1):
        pad = "    " * depth
        if isinstance(node, bool):
            return f"{pad}return {node}\n"
        return f"{pad}if r[{node[0]}] <= {float(node[1])!r}:\n{source(node[2], depth + 1)}{pad}else:\n{source(node[3], depth + 1)}"

    scope = {}
    exec("def by_hand(r):\n" + source(tree()), scope)  # noqa: S102
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(40).collect():
        found = blocks(row.html)
        assert main_text(row.html) == "\n".join(b.text for b, r in zip(found, table_of(found).tolist()) if scope["by_hand"](r))
    assert not hasattr(module, "MAIN_LEAST")
