"""HTML extraction: priors and importance together, the style tree against a plain one, and odd pages."""

import math
import random
from collections import Counter, defaultdict

import pytest

from spectrafold.llm import html_text


def text_of(page, tree=None):
    return html_text.main_text(page, tree or {})[0]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body class="no-sidebar"><p>a</p></body>', "a"),
        ('<body class="has-header"><nav>n</nav><p>a</p></body>', "a"),
        ('<article class="post social-science"><p>a</p></article>', "a"),
        ('<div class="story comment-count-3"><p>a</p></div>', "a"),
        ("<form><div><p>a</p></div></form>", "a"),
        ("<form><nav>x</nav><article><p>a</p></article></form>", "a"),
        ('<p data-hidden="1" data-id="ad" data-role="banner">a</p>', "a"),
        ("<article><header><h1>T</h1><nav>q</nav><p>by</p></header><p>a</p></article>", "T a"),
        ("<header><h1>Site</h1></header><article><p>a</p></article>", "a"),
        ('<div class="comments"><article class="comment"><p>no</p></article></div><p>yes</p>', "yes"),
        ('<article><p>a</p><section id="comments"><p>c</p></section></article>', "a"),
        ('<div class="ad-box">x</div><div id="site-footer">y</div><div role="navigation">z</div>a', "a"),
        ("<article><p class=ad>x</p><p>a<span class=share>s</span></p></article>", "a"),
        ("<nav>only a menu</nav>", ""),
        ("<div hidden>h</div><div aria-hidden=true>h</div><div style='display: none'>h</div>a", "a"),
        ("<div>a<br>b<hr>c</div>", "a b c"),
        # an article isn't all that counts
        ('<div class="post"><h1>Title</h1><p>The story itself.</p></div><section><article><p>Teaser one</p></article></section>', "Title The story itself. Teaser one"),
        ("<main><h1>T</h1><article><p>a</p></article><p>the end</p></main>", "T a the end"),
        ('<div class="post-header"><h1>T</h1><span>by me</span></div><article><p>a</p></article>', "T a"),
        ('<div class="page-header"><h1>Site</h1></div><div id="header"><h1>S</h1></div><article><p>a</p></article>', "a"),
        ('<main><aside class="related"><article><p>x</p></article></aside><p>a</p></main>', "a"),
    ],
)
def test_priors(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("tag", ["div", "b", "p", "li", "td", "article"])
def test_pages_of_any_depth_and_length(tag):
    n = 20_000
    assert text_of(f"<{tag}>" * n + "deep" + f"</{tag}>" * n + "</p>" * n) == "deep"
    assert text_of("<article>" + f"<{tag}>x" * 3000 + "</article>").replace(" ", "") == "x" * 3000


def site(n=24, seed=1):
    """Pages of one host: unmarked templates, a list that differs, and articles in a marked or unmarked branch."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    out = []
    for i in range(n):
        story = " ".join(word() for _ in range(30))
        top = "<div><div>Best prices in town</div><div>Call now</div></div>"
        mixed = f'<div class="content sidebar"><div>{word() if i % 2 else "Subscribe"}</div></div>'
        out.append((i, f"http://h.test/{i}", f'<body>{top}<section><p>{story}</p></section>{mixed}<div id="x{i}">{"" if i % 3 else "Terms"}</div></body>'))
    return out


def plain_tree(pages):
    """(key, kind): (importance, ways) of one host, in plain Python."""
    seen = defaultdict(Counter)
    for _, _, page in pages:
        for node, inner in html_text.assign_keys(html_text.parse(page or "")):
            value = node.bare_style if inner else " ".join(node.text().split())
            for key in {node.key, node.loose}:
                seen[key, 1 if inner else 2][value] += 1
    out = {}
    for place, values in seen.items():
        m = sum(values.values())
        if m >= html_text.LEAST_PAGES:
            out[place] = (sum(-n / m * math.log(n / m) for n in values.values()) / math.log(m), len(values))
    return out


def test_style_tree_equals_a_plain_one(spark):
    pages = site()
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = plain_tree(pages)
    rows = html_text.style_tree(df).collect()
    got = {(r["key"] & (1 << 64) - 1, r["kind"]): (r["importance"], r["ways"]) for r in rows}
    assert {r["host"] for r in rows} == {"h.test"} and got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    texts = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert texts == {i: text_of(page, want) for i, _, page in pages}


def test_pages_change_when_the_tree_is_emptied():
    pages = site()
    tree = plain_tree(pages)
    changed = [i for i, _, page in pages if text_of(page, tree) != text_of(page)]
    assert len(changed) == len(pages)
    for i, _, page in pages:
        assert "Best prices" not in text_of(page, tree) and "Best prices" in text_of(page)
        assert len(text_of(page, tree).split()) >= 30


def test_branches_of_low_importance_keep_their_articles():
    page = "<body><div><div>Best prices</div><article><p>a</p></article><section><p>template</p></section></div></body>"
    root = html_text.parse(page)
    nodes = html_text.assign_keys(root)
    tree = {(n.key, 1 if inner else 2): (0.0, 1) for n, inner in nodes if n.tag not in ("html", "body")}
    assert html_text.main_text(page, tree)[0] == "a" and "Best prices" in html_text.main_text(page, {})[0]


def test_odd_tables(spark):
    page = "<article><p>a</p></article>"
    rows = [(1, "http://h.test/1", page, "t", 5, None, "p", None)] * 2 + [(2, None, None, None, None, "x", None, 1), (3, "no url", "", "t", 1, "y", "q", 2), (4, "http://h.test/4", "<p>" + "long " * 200_000, "", 0, "", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, tree string, _page int, _host string, row string, importance int")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "url", "html", "tree", "_page", "_host", "row", "text", "importance"]
    got = sorted((r["page_id"], r["text"][:10], r["tree"], r["_page"], r["_host"], r["row"]) for r in out.collect() if r["page_id"] != 2)
    assert got == [(1, "a", "t", 5, None, "p")] * 2 + [(3, "", "t", 1, "y", "q"), (4, "long long ", "", 0, "", "")]
    assert html_text.extract(df.limit(0)).count() == 0 and out.count() == 5
