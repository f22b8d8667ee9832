"""Main text of web pages by site style trees and structural marks.

The DOMs of one host are merged into a style tree: an element is known by its path, that is, for each
step the sequence of child tags it stands in and its place there, so that equal layouts of pages meet. Steps
have classes and ids; where an id or a class with a digit is a page's own, the element is known by the path
without ids and such classes. For each element that at least ``LEAST_PAGES`` pages of the host share, the
tree has its presentation importance (entropy of its child sequences over the pages, to the base of their
number) and the importance of its content (entropy of its texts likewise; equal texts everywhere give 0).
Rarer elements have importance 1. In each page, importance is carried upwards as in the published method: with
l child sequences, (1 - 0.9^l) of the own presentation and 0.9^l of the mean over the children. Branches
under ``THRESHOLD`` are removed.

Templates whose texts differ on every page can't be told from articles by entropy, and copies of one
article look like a template. So the importance is evidence beside a prior (``PRIORS``) in log odds that tags,
roles, classes and ids give: an unmarked branch goes if its importance is below ``THRESHOLD``; marks of
menus, headers, footers, sidebars, notices, adverts, forms or reader comments make that stricter, marks of
articles laxer; the importance can raise the log odds by 1 and lower them by 3. Scripts, styles, hidden
elements and controls hold no text. Where a page has an article (or a main element), the text is taken from
there; articles and paragraphs never go for low importance alone; a header inside an article leaves its
headings. A page that would be left without text is read once more without the priors of classes, ids
and forms, which a wrapper of the whole page may have.

Defined results: null pages are empty; a page without text gives an empty string; unclosed and misnested
tags are closed as browsers do for paragraphs and list items; the rest of a page after an unfinished tag
is dropped. Pages may be nested to any depth and be of any length. Null and malformed URLs share the empty
host. Equal rows are extracted each; an empty table gives an empty table. Columns are kept, whatever their
names; ``text`` and ``importance`` replace columns of these names.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, cut

LEAST_PAGES, THRESHOLD, GAMMA = 4, 0.3, 0.9
#: Trees of up to so many entries in all (40 bytes each) go to all workers; larger ones are joined by host and key.
BROADCAST_ENTRIES = 200_000

# Element names and marks (fixed values of the HTML standard and of common usage).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption td th".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body article main section div nav td th select".split())
NO_TEXT = frozenset("head script style noscript template iframe object svg canvas button select option textarea input title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_TAGS = frozenset("nav header footer aside menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NOISE_MARKS = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo banner sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup comment comments disqus respond share sharing social related recommended widget pagination".split()
)
MAIN_MARKS = frozenset("article story post entry content main body text".split())
#: Words that make a class a state of the page ("no-sidebar") and not a mark of the element.
STATES = frozenset("no not without has have with is hide show".split())
#: Log odds that marks add: a tag or role, a class or id that is a mark, one that has a mark at an end.
PRIORS = {"noise tag": -3.0, "main tag": 2.0, "form": -2.0, "noise name": -3.0, "noise part": -2.0, "main name": 2.0, "main part": 1.0, "prose": 3.0, "in main": 1.5}
#: How far importance moves the log odds.
LOWEST, HIGHEST = -3.0, 1.0

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_MARKED = re.compile(r"(?<![\w:.-])(class|id|role|aria-hidden|hidden|style)(?![\w:.-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGIT = re.compile(r"\d")
_PARTS = re.compile(r"[a-z]+")


class Node:
    """An element: children are nodes and strings. ``tagged`` and ``named``: the priors of its tag and role, and of its names."""

    __slots__ = ("bare", "children", "empty", "key", "loose", "mark", "named", "tag", "tagged")

    def __init__(self, tag: str, mark: str = "", bare: str = "", empty: bool = False, tagged: float = 0.0, named: float = 0.0) -> None:
        self.tag, self.mark, self.bare, self.empty, self.tagged, self.named = tag, mark, bare, empty, tagged, named
        self.children: list[Node | str] = []
        self.key = self.loose = 0

    @property
    def style(self) -> str:
        """The sequence of child elements, text between them included."""
        return " ".join(c.tag + c.mark if isinstance(c, Node) else "#" for c in self.children)

    @property
    def bare_style(self) -> str:
        """The same without what may be a page's own: ids, and classes with digits."""
        return " ".join(c.tag + c.bare if isinstance(c, Node) else "#" for c in self.children)

    def text(self) -> str:
        out, rest = [], [self]
        while rest:
            node = rest.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                rest.extend(reversed(node.children))
        return "".join(out)


def name_prior(value: str) -> float:
    """The log odds that the names of a class or id attribute give."""
    noise = main = 0.0
    for name in value.split():
        parts = _PARTS.findall(name)
        if not parts or not STATES.isdisjoint(parts):
            continue
        whole, ends = len(parts) == 1, {parts[0], parts[-1]}
        if not NOISE_MARKS.isdisjoint(ends):
            noise = min(noise, PRIORS["noise name" if whole else "noise part"])
        elif not MAIN_MARKS.isdisjoint(ends):
            main = max(main, PRIORS["main name" if whole else "main part"])
    return noise + main


def element(tag: str, raw: str) -> Node:
    """An element by its tag and attributes."""
    mark = bare = ""
    empty = tag in NO_TEXT
    tagged = PRIORS["noise tag"] if tag in NOISE_TAGS else PRIORS["main tag"] if tag in MAIN_TAGS else 0.0
    named = PRIORS["form"] if tag == "form" else 0.0
    for name, *values in _MARKED.findall(raw) if raw else ():
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name in ("class", "id"):
            mark += ("." if name == "class" else "@") + value
            if name == "class":
                bare += "." + (" ".join(c for c in value.split() if not _DIGIT.search(c)) if _DIGIT.search(value) else value)
            named += name_prior(value)
        elif name == "role":
            tagged += PRIORS["noise tag"] if value in NOISE_ROLES else PRIORS["main tag"] if value in MAIN_TAGS else 0.0
        elif name == "hidden":
            empty = True
        elif name == "aria-hidden":
            empty |= value == "true"
        else:
            empty |= "display:none" in value.replace(" ", "")
    if tag in ("html", "body"):  # the whole page
        empty, tagged, named = False, 0.0, 0.0
    return Node(tag, mark, bare, empty, tagged, named)


def parse(page: str) -> Node:
    """The tree of a page; character references are decoded."""
    root = Node("#page")
    stack, at = [root], 0
    opened: Counter[str] = Counter()  # how often each tag is on the stack

    def close(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    while True:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            unfinished = re.search(r"<[a-zA-Z/!?]", piece) if not m else None
            piece = piece[: unfinished.start()] if unfinished else piece
            stack[-1].children.append(html.unescape(piece))
        if not m:
            return root
        at = m.end()
        if m[0].startswith("<![CDATA["):
            stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if not opened[name]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    close(i)
                    break
                if name in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if name in CLOSES_P or name in SIBLINGS:
            ends = SIBLINGS.get(name, {"p"})
            for i in range(len(stack) - 1, 0, -1) if any(opened[e] for e in ends) else ():
                if stack[i].tag in ends:
                    close(i)
                    if name not in ("tr",):
                        break
                elif stack[i].tag in SCOPES:
                    break
        node = element(name, m[3])
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name in ("title", "textarea"):
                node.children.append(html.unescape(page[at : end.start() if end else len(page)]))
            at = end.end() if end else len(page)
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[name] += 1


def assign_keys(root: Node) -> list[tuple[Node, bool]]:
    """Give each element that the style tree holds its keys, with and without ids; returns these, with whether they have inner elements.

    Elements inside paragraphs, headings and other prose belong to their text.
    """
    out: list[tuple[Node, bool]] = []
    root.key = root.loose = xxhash.xxh64_intdigest(root.tag)
    rest = [root]
    while rest:
        node = rest.pop()
        inner = [c for c in node.children if isinstance(c, Node) and c.tag not in INLINE and c.tag not in VOID] if node.tag not in PROSE else []
        out.append((node, bool(inner)))
        base = xxhash.xxh64_intdigest(node.style, node.key) if inner else 0
        loose = xxhash.xxh64_intdigest(node.bare_style, node.loose) if inner else 0
        for i, child in enumerate(inner):
            child.key = xxhash.xxh64_intdigest(f"{i} {child.tag}{child.mark}", base)
            child.loose = xxhash.xxh64_intdigest(f"{i} {child.tag}{child.bare}", loose)
            rest.append(child)
    return out


def tree_rows(df: DataFrame, page: str, url: str) -> DataFrame:
    """host, key, kind (page, style or text), value, n: what the pages of each host have at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                counts: dict[tuple[str, int, int, int], int] = {}
                for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    nodes = assign_keys(parse(text or ""))
                    for node, inner in nodes:
                        kind, value = (1, xxhash.xxh64_intdigest(node.bare_style)) if inner else (2, xxhash.xxh64_intdigest(" ".join(node.text().split())))
                        for key in {node.key, node.loose}:
                            k = (host, key, kind, value)
                            counts[k] = counts.get(k, 0) + 1
                columns = list(zip(*((h, k, kind, v, n) for (h, k, kind, v), n in counts.items()))) or [()] * 5
                signed = lambda c: pa.array(np.array(c, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), signed(columns[1]), pa.array(columns[2], pa.int32()), signed(columns[3]), pa.array(columns[4], pa.int64())], names=["host", "key", "kind", "value", "n"])

    rows = df.select(_host(url).alias("host"), F.col(page).alias("page")).mapInArrow(run, "host string, key long, kind int, value long, n long")
    return rows.groupBy("host", "key", "kind", "value").agg(F.sum("n").alias("n"))


def _host(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def style_tree(df: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """host, key, kind, importance, ways of the elements on enough pages, ways being how many styles there are."""
    rows = tree_rows(df, page, url)
    # -sum(p ln p) = ln m - sum(n ln n) / m
    by_key = rows.groupBy("host", "key", "kind").agg(F.sum("n").alias("m"), F.count("*").alias("ways"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    importance = F.greatest(F.lit(0.0), F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")
    return by_key.where(F.col("m") >= LEAST_PAGES).select("host", "key", "kind", importance.alias("importance"), "ways")


#: (importance, ways) of an element by its key and kind.
Tree = dict[tuple[int, int], tuple[float, int]]


def importances(nodes: list[tuple[Node, bool]], tree: Tree) -> dict[int, float]:
    """The importance of each element of a page that the tree has, by id(node), from the leaves upwards."""
    out: dict[int, float] = {}
    known: dict[int, float] = {}
    for node, inner in reversed(nodes):
        kind = 1 if inner else 2
        found = tree.get((node.key, kind)) or tree.get((node.loose, kind))
        value, ways = found or (1.0, 1)
        if inner and found:
            below = [out[id(c)] for c in node.children if isinstance(c, Node) and id(c) in out and not c.empty]
            share = GAMMA**ways
            value = (1 - share) * value + share * (sum(below) / len(below) if below else 1.0)
        out[id(node)] = value
        if found:
            known[id(node)] = value
    return known


#: The log odds of an unmarked element without evidence: importance under the threshold brings them below 0.
_BASE = math.log((1 - THRESHOLD) / THRESHOLD)


class Judge:
    """Tells which elements of a page stay. ``names``: whether classes, ids and forms count."""

    def __init__(self, weight: dict[int, float], names: bool) -> None:
        self.weight, self.names = weight, names
        self.mains: list[Node] = []

    def marked(self, node: Node) -> bool:
        """Whether tag, role or names say that an element isn't content."""
        return node.tagged < 0 or self.names and node.named < 0

    def keeps(self, node: Node, inside: bool) -> bool:
        """Whether an element stays; ``inside``: of an article or main element."""
        if node.empty or node.tag in VOID:  # a void element parts words
            return not node.empty
        odds = node.tagged + (node.named if self.names else 0.0)
        if odds >= 0:
            odds += PRIORS["prose"] if node.tag in PROSE or node.tag in INLINE else PRIORS["in main"] if inside else 0.0
        odds += _BASE
        importance = self.weight.get(id(node))
        if importance is not None:
            low, high = math.exp(LOWEST), math.exp(HIGHEST)
            ratio = importance / (1 - importance) if importance < 1 else high
            evidence = math.log(min(max(ratio, low), high))
            # an article is never a template, however many copies of it the host has
            odds += max(0.0, evidence) if node.tag in ("html", "body", *MAIN_TAGS) else evidence
        return odds >= 0

    def within(self, branch: Node) -> list[Node]:
        """The outermost articles, or else main elements, that stay in a branch that doesn't."""
        for wanted in ("article", "main"):
            found, rest = [], [branch]
            while rest:
                node = rest.pop()
                if node is not branch and (node.empty or self.marked(node) and node.tag != "form"):
                    continue
                if node.tag == wanted and self.keeps(node, False):
                    found.append(node)
                else:
                    rest += [c for c in reversed(node.children) if isinstance(c, Node)]
            if found:
                return found
        return []

    def text(self, root: Node) -> str:
        """The texts of what stays, in page order."""
        out: list[str] = []
        rest: list[tuple[Node | str, bool]] = [(root, False)]
        while rest:
            node, inside = rest.pop()
            if isinstance(node, str):
                out.append(node)
                continue
            if node.tag in MAIN_TAGS and not inside:
                self.mains.append(node)
                inside = True
            gap = "" if node.tag in INLINE else " "
            out.append(gap)
            rest.append((gap, inside))
            for child in reversed(node.children):
                if isinstance(child, str) or self.keeps(child, inside):
                    rest.append((child, inside))
                elif child.empty:
                    continue
                elif inside and child.tag == "header" or self.names and child.tagged >= 0 and heads_article(child.mark):
                    rest.extend((h, inside) for h in reversed(headings(child)))
                elif child.tag == "form" or not self.marked(child):  # a branch of low importance may hold an article, a marked one may not
                    rest.extend((n, inside) for n in reversed(self.within(child)))
        return " ".join("".join(out).split())


def heads_article(mark: str) -> bool:
    """Whether a class or id is that of the header of an article ("post-header"), not of the page."""
    return any(parts[-1:] == ["header"] and not MAIN_MARKS.isdisjoint(parts) for parts in map(_PARTS.findall, re.split(r"[\s.@]+", mark)))


def headings(node: Node) -> list[Node]:
    """The headings in an element."""
    found, rest = [], [node]
    while rest:
        one = rest.pop()
        if one.tag in HEADINGS:
            found.append(one)
        else:
            rest += [c for c in reversed(one.children) if isinstance(c, Node) and not c.empty]
    return found


def main_text(page: str | None, tree: Tree) -> tuple[str, float]:
    """The main text of a page, and the mean importance of its articles (of the page, if it has none)."""
    if not page:
        return "", 0.0
    root = parse(page)
    weight = importances(assign_keys(root), tree)
    for names in (True, False):
        judge = Judge(weight, names)
        text = judge.text(root)
        if text:
            break
    mains = judge.mains or [root]
    return text, sum(weight.get(id(n), 1.0) for n in mains) / len(mains)


def _page_trees(df: DataFrame, tree: DataFrame) -> DataFrame:
    """a, b (the hashes of a page) and tree: the entries of its elements, joined by host and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                at, keys = [], []
                for i, text in enumerate(batch.column("page").to_pylist()):
                    found = {k for node, _ in assign_keys(parse(text or "")) for k in (node.key, node.loose)}
                    at += [i] * len(found)
                    keys += found
                picked = batch.select(["a", "b", "host"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.array(keys, np.uint64).view(np.int64))], names=["a", "b", "host", "key"])

    needed = df.select("a", "b", "host", "page").mapInArrow(run, "a long, b long, host string, key long").distinct()
    return needed.join(tree, ["host", "key"]).groupBy("a", "b").agg(F.collect_list(F.struct("key", "kind", "importance", "ways")).alias("tree"))


def extract(df: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """``df`` with ``text``, the main text, and ``importance``, that of the elements it comes from."""
    tree = cut(style_tree(df, page, url))
    read = df.select(beside(df, "text", "importance"), F.col(page).alias("page"), _host(url).alias("host"))
    small = tree.count() <= BROADCAST_ENTRIES
    spans: dict[str, tuple[int, int]] = {}
    if small:
        held = tree.toArrow().sort_by("host").combine_chunks()
        hosts, starts = np.unique(held["host"].to_numpy(), return_index=True) if len(held) else ([], [])
        spans = {h: (int(a), int(b)) for h, a, b in zip(hosts, starts, [*starts[1:], len(held)])}
        columns = [held[c].to_numpy() for c in ("key", "kind", "importance", "ways")]
    else:
        read = read.withColumns({"a": F.xxhash64("host", "page"), "b": F.xxhash64(F.lit(1), "page", "host")})
        read = read.join(_page_trees(read, tree), ["a", "b"], "left").select("row", "page", "host", "tree")
        columns = []
    schema = T.StructType([read.schema["row"], T.StructField("text", T.StringType()), T.StructField("importance", T.DoubleType())])
    low = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Tree] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts, weights = [], []
                for i, (host, text) in enumerate(zip(batch.column("host").to_pylist(), batch.column("page").to_pylist())):
                    if not small:
                        mine = {(e["key"] & low, e["kind"]): (e["importance"], e["ways"]) for e in batch.column("tree")[i].as_py() or []}
                    elif host in known:
                        mine = known[host]
                    else:
                        if len(known) > 200:
                            known.clear()
                        a, b = spans.get(host, (0, 0))
                        mine = known[host] = {(k & low, kind): (x, n) for k, kind, x, n in zip(*(c[a:b].tolist() for c in columns))}
                    t, w = main_text(text, mine)
                    texts.append(t)
                    weights.append(w)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(weights, pa.float64())], names=schema.names)

    return read.mapInArrow(run, schema).select("row.*", "text", "importance")
