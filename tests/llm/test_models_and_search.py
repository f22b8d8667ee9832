"""HTML, language, toxicity, search and URL lists on small cases."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.llm import html_text, language_id, topk_search, toxicity, url_lists


def text_of(page):
    return html_text.main_text(page, {})[0]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p>a  b\n c<p>d<br>e", "a b c d e"),
        ("<body><nav>x</nav><article><h1>T</h1><p>a<b>b</b>c &amp; &lt;d&gt; &eacute;</p></article><footer>f</footer>", "T abc & <d> é"),
        ("<article><p>one</p><script>var a='</p>';</script><style>p{}</style><!-- c --><div class='ad-box'>buy</div><form>f</form><p>two</article>", "one two"),
        ("<main><p>x</p><aside>y</aside><div id=comments><p>z</p></div></main>", "x"),
        ("<div class=cookie-notice>c</div><div><p>kept</p></div>", "kept"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
        ("<article><p>a &am b &copy; c</p><p unfinished", "a &am b © c"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<article><article class=comment><p>no</p></article><p>yes</p></article>", "yes"),
        ("</b></div><p>stray</p>", "stray"),
    ],
)
def test_main_text(page, want):
    assert text_of(page) == want


def test_style_tree_removes_templates(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><section><div>Always the same</div></section><section><p>{'w' * i} text {i}</p></section></body>") for i in range(12)]
    rows = html_text.extract(spark.createDataFrame([*pages, (90, None, None)], "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in rows}
    assert texts[5] == "wwwww text 5" and texts[90] == "" and len(rows) == 13
    lone = html_text.extract(spark.createDataFrame(pages[:1], "page_id long, url string, html string")).first()
    assert lone["text"] == "Always the same text 0"


def test_language(spark):
    rng = random.Random(1)
    words = {"xx": ["lorem", "ipsum", "dolor", "amet"], "yy": ["zwölf", "boxkämpfer", "jagen", "quer"], "zz": ["ça", "où", "naïf", "garçon"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(rng.choice(list(words)) for _ in range(150))]
    docs = spark.createDataFrame([*rows, (900, None, "xx"), (901, "123 !", "xx"), (902, "lorem", None)], "doc_id long, text string, lang string")
    model = language_id.learn(docs, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == k and 0.5 < got[i]["score"] <= 1 for i, _, k in rows)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "xx"
    assert language_id.learn(docs.limit(0)) is None
    assert language_id.predict(docs, None).where("lang_pred <> 'und'").count() == 0


def test_temperature():
    rng = np.random.default_rng(0)
    scores = rng.standard_normal((4000, 3)) * 2
    p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
    labels = [int(rng.choice(3, p=row)) for row in p]
    assert abs(language_id.temperature(list(scores * 5), labels) - 5) < 0.6


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_and_matcher():
    terms = [toxicity.Term(t, False, 3.0) for t in ("abcde", "bcdea", "ddddd")]
    matcher, rng = toxicity.Matcher(terms), random.Random(2)
    for _ in range(3000):
        word = "".join(rng.choice("abcde") for _ in range(rng.randint(3, 7)))
        want = min(plain_distance(word, t.text) for t in terms) <= 1
        assert (matcher.match(word) is not None) == want, word


def test_quotation():
    matcher = toxicity.Matcher([toxicity.Term("stupid", False, 4.0)])
    plain, quoted = toxicity.features("you are so stupid", matcher), toxicity.features("he said “stupid” to us", matcher)
    assert plain[0] > 0 and plain[3] == 0 and quoted[0] == 0 and quoted[3] > 0


def test_toxicity(spark):
    rng = random.Random(3)
    clean = lambda: [rng.choice("the of and to in it is on by at we us".split()) for _ in range(30)]
    rows, labels = [], []
    for i in range(400):
        words, bad = clean(), i % 8 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["nasty", "vile", "rotten"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "so nastyy and rottn and vile"), (902, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert sum(got[i]["predicted"] != y for i, y in labels) <= 4
    assert got[900]["predicted"] == got[902]["predicted"] == 0 and got[901]["predicted"] == 1
    empty = toxicity.learn(docs, marks.limit(0))
    assert toxicity.score(docs, empty).where("score <> 0").count() == 0


def plain_top_k(vectors, k):
    out = set()
    fine = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in fine if i % 50 == 0):
        best = sorted(((-int(fine[q] @ v), i) for i, v in fine.items() if i != q))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_top_k(spark, ties):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(np.float32(x)) for x in (rng.integers(-2, 3, 6) / 4 if ties else rng.standard_normal(6))]) for i in range(300)]
    vectors += [(350, None), (351, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (352, [float("nan")] * 6), (400, [0.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = topk_search.top_k(df, F.col("vec_id") % 50 == 0, candidates=64)
    assert {tuple(r) for r in got.collect()} == plain_top_k(vectors, 5)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk_search.top_k(df.limit(1), F.col("vec_id") % 50 == 0).count() == 0


def test_threshold_search_stops_early():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-20, 20, (20_000, 8))
    vectors[:5] = 4000
    block = topk_search.Block(np.arange(20_000), vectors)
    place, ids, scores = block.search(np.array([-1, -2]), np.array([[3, 2, 1, 1, 0, 0, 0, 0], [1] * 8]), 5)
    assert ids.tolist() == [0, 1, 2, 3, 4] * 2 and scores.tolist() == [28000] * 5 + [32000] * 5
    assert block.scored < 0.05 * 2 * 20_000
    block.scored = 0  # a floor that no candidate reaches ends the search at the list heads
    assert len(block.search(np.array([-1]), np.ones((1, 8), int), 5, np.array([10**6]))[0]) == 0 and block.scored < 400


def test_searches_with_floors_equal_plain_ones():
    rng = np.random.default_rng(6)
    for spread in (3, 1000):
        vectors = rng.integers(-spread, spread, (700, 5)) // rng.integers(1, 40, (700, 1))
        queries = rng.integers(-4, 5, (40, 5))
        queries[0] = 0
        want = [sorted((-int(s), i) for i, s in enumerate(vectors @ q) if i != at)[:4] for at, q in enumerate(queries)]
        for floors in (None, np.array([-w[-1][0] for w in want])):
            place, ids, scores = topk_search.Block(np.arange(700), vectors).search(np.arange(40), queries, 4, floors)
            assert [sorted(zip((-scores[place == i]).tolist(), ids[place == i].tolist())) for i in range(40)] == want


def test_top_k_edge_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (50, []), (51, []), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (None, [9.0, 9.0]), (2, [0.5] * 3000), (100, [0.25] * 3000)]
    df = spark.createDataFrame([(i, v, "x", 1.0, 0) for i, v in rows], "vec_id long, embedding array<double>, q string, score double, block int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0, k=3, candidates=2).collect())
    assert got == [(0, 1, 1, 131072), (0, 2, 1, 131072), (0, 3, 1, 65536), (50, 1, 51, 0), (100, 1, 2, 128 * 64 * 3000)]


def test_url_lists(spark):
    day = lambda d: date(2024, 1, d)
    entries = spark.createDataFrame([("bad.com", day(3), "add"), ("bad.com", day(9), "remove"), ("bad.com", day(15), "add"), ("x.org/en", day(1), "add"), ("bad.com/deep/er", day(1), "add"), (None, day(1), "add"), ("same.net", day(2), "add"), ("same.net", day(2), "remove")], "pattern string, day date, action string")
    cases = [
        (1, "http://bad.com/", day(2), None), (2, "http://a.bad.com/q", day(3), "bad.com"), (3, "https://u@bad.com:8080/x", day(8), "bad.com"), (4, "http://bad.com", day(9), None),
        (5, "http://BAD.com./z?q#f", day(20), "bad.com"), (6, "http://notbad.com/", day(5), None), (7, "http://x.org/en/a", day(5), "x.org/en"), (8, "http://x.org/english", day(5), None),
        (9, "http://bad.com/deep/er/y", day(5), "bad.com/deep/er"), (10, None, day(5), None), (11, "mailto:x", day(5), None), (12, "http://bad.com", None, None), (13, "http://same.net", day(3), None), (13, "http://same.net", day(3), None),
    ]
    captures = spark.createDataFrame([(i, u, t, "mine") for i, u, t, _ in cases], "page_id int, url string, fetched date, pattern string")
    got = url_lists.evaluate(captures, entries).collect()
    assert sorted((r["page_id"], str(r["pattern"]), r["blocked"]) for r in got) == sorted((i, str(p), p is not None) for i, _, _, p in cases)
    assert url_lists.evaluate(captures.limit(0), entries).count() == 0
    assert url_lists.evaluate(captures, entries.limit(0)).where("blocked").count() == 0
