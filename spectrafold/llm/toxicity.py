"""Toxicity: a learned lexicon, matched with one spelling error, and scores of the context of each match.

Words and word beginnings that labelled toxic documents have much more often than others make a lexicon,
held as a trie. A word of a text matches a term if the Levenshtein automaton of the word (one edit, for
terms of five letters or more) and the trie share a path; for a beginning, the trie has the words of toxic
texts that it stands for. The window around a match tells quotation (a pair of marks around it, or a verb
of saying before it) from abuse. A logistic regression on what the matches of a text add up to gives the
score; it is fitted on matches of lexica that were learned without the text.

Terms have to be in at least three of the texts learned from and reach a bound on their low log odds; of
these a text keeps up to four, the most telling first (``cover``), so that words which merely occur in the
same texts don't join the lexicon. Near copies in the sample count once, the one with the smallest id.

Learning uses a sample of the labelled rows whose size is bounded by ``sample``; scoring reads whole texts.
The matcher and the fit don't see labels, language, source or id.

Defined results: null and empty texts have no matches; a text without a match scores as one of at least the
length of the shortest text learned from, and never above the share of toxic labels; without labels of both kinds every score is the
share of toxic labels (0 if there are none), also for an empty table. Rows with null labels or ids aren't
learned from; equal label rows, and rows of one id, count each; ties of terms go to the longer list of
texts, then to the alphabet. Texts and words may be of any length. All columns of the scored rows are kept,
whatever their names, equal rows each; ``score`` and ``predicted`` replace columns of these names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stores
from .common import from_driver, portions, texts, unit_hash
from .fingerprints import shingle_hashes

_WORDS = re.compile(r"\w+")
_MARKS = re.compile(r"[\"“”„«»‘’]|\n\s*\n")
#: Verbs of saying and marks around quotations (fixed values).
SAYING = frozenset("said says wrote writes called quoted quotes quote reads dijo dice escribió llamó citó dit écrit appelé cite sagte sagt schrieb nannte zitiert".split())
OPENING = {"“": "”", "„": "“”", "«": "»", "‘": "’", "\"": "\"", "»": "«"}
WINDOW = 6
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
FUZZY_LENGTH = 5
N_FEATURES = 6
#: Least hashes of a text by which near copies in the sample are told.
SKETCH = 16


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float
    #: The words of toxic texts that a stem stands for.
    words: tuple[str, ...] = ()


class Automaton:
    """The Levenshtein automaton of a word for one edit: states are sets of (position, edits)."""

    def __init__(self, word: str) -> None:
        self.word = word
        self.start = self._close({(0, 0)})

    def _close(self, state: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        skipped = {(i + 1, 1) for i, e in state if e == 0 and i < len(self.word)}  # a letter of the word too many
        return frozenset(state | skipped)

    def step(self, state: frozenset[tuple[int, int]], letter: str) -> frozenset[tuple[int, int]]:
        out = set()
        for i, e in state:
            if i < len(self.word) and self.word[i] == letter:
                out.add((i + 1, e))
            if e == 0:
                out.add((i, 1))  # a letter of the word is missing
                if i < len(self.word):
                    out.add((i + 1, 1))  # another letter
        return self._close(out)

    def accepts(self, state: frozenset[tuple[int, int]]) -> bool:
        return any(i == len(self.word) for i, _ in state)


class Matcher:
    """Finds the term that a word stands for; a bounded number of words is remembered."""

    def __init__(self, terms: list[Term], cache_size: int = 300_000) -> None:
        self.exact = {t.text: t for t in terms if not t.stem}
        self.stems = {t.text: t for t in terms if t.stem}
        self.stem_lengths = sorted({len(x) for x in self.stems})
        self.trie: dict = {}
        self.halves: set[tuple[str, bool, int]] = set()
        for t, spelling in ((t, s) for t in terms for s in (t.words if t.stem else (t.text,))):
            if len(spelling) < FUZZY_LENGTH or not spelling.isalpha():
                continue
            node = self.trie
            for letter in spelling:
                node = node.setdefault(letter, {})
            if "" not in node or node[""].weight < t.weight:
                node[""] = t
            # with one edit at most, one half of the term is there unchanged, at its end of the word
            n = len(spelling)
            for size in (n - 1, n, n + 1):
                self.halves.add((spelling[: n // 2], True, size))
                self.halves.add((spelling[n // 2 :], False, size))
        self.half_lengths = sorted({len(h) for h, _, _ in self.halves})
        self.known: dict[str, tuple[Term, bool] | None] = {}
        self.size = cache_size

    def match(self, word: str) -> tuple[Term, bool] | None:
        """The term and whether the word is written as the term."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > self.size:
            self.known.clear()
        found = self.known[word] = self._match(word)
        return found

    def _match(self, word: str) -> tuple[Term, bool] | None:
        if word in self.exact:
            return self.exact[word], True
        stems = [self.stems[word[:n]] for n in self.stem_lengths if len(word) > n and word[:n] in self.stems]
        if stems:
            return max(stems, key=lambda t: t.weight), True
        size = len(word)
        if any((word[:n], True, size) in self.halves or (word[-n:], False, size) in self.halves for n in self.half_lengths):
            return self._fuzzy(word)
        return None

    def _fuzzy(self, word: str) -> tuple[Term, bool] | None:
        automaton, best = Automaton(word), None
        rest = [(self.trie, automaton.start)]
        while rest:
            node, state = rest.pop()
            for letter, child in node.items():
                if letter == "":
                    if automaton.accepts(state) and (best is None or child.weight > best.weight):
                        best = child
                elif after := automaton.step(state, letter):
                    rest.append((child, after))
        return (best, False) if best else None


def quotations(text: str) -> list[tuple[int, int]]:
    """Where quotations begin and end: pairs of marks in one paragraph. An apostrophe opens and closes nothing."""
    found, start, ends = [], -1, ""
    for m in _MARKS.finditer(text):
        mark, at = m[0], m.start()
        if mark[0] == "\n":
            start = -1
        elif start >= 0 and mark in ends:
            inside = mark == "’" and at + 1 < len(text) and text[at - 1].isalnum() and text[at + 1].isalnum()
            if not inside:  # of a word, as in it’s
                found.append((start, at))
                start = -1
        elif start < 0 and mark in OPENING:
            start, ends = at, OPENING[mark]
    return found


def features(text: str | None, matcher: Matcher) -> list[float]:
    """What the matches of a text add up to, quotations apart from the rest."""
    low = (text or "").lower()
    words = _WORDS.findall(low)
    known, match = matcher.known, matcher.match
    hits = [(i, m) for i, w in enumerate(words) if (m := known[w] if w in known else match(w))]
    if not hits:
        return [0.0] * (N_FEATURES - 1) + [math.log1p(len(words))]
    spans, quotes = [m.span() for m in _WORDS.finditer(low)], quotations(low)
    weight = fuzzy = quoted = near = 0.0
    terms, last = set(), -1000
    for i, (term, as_written) in hits:
        marks = any(start < spans[i][0] and spans[i][1] <= end for start, end in quotes)
        if marks or SAYING.intersection(words[max(0, i - WINDOW) : i]):
            quoted += 1
            continue
        weight += term.weight * (1 if as_written else 0.7)
        fuzzy += not as_written
        near += i - last <= 2 * WINDOW
        last = i
        terms.add(term.text)
    return [math.log1p(weight), min(len(terms), 4), math.log1p(fuzzy), math.log1p(quoted), math.log1p(near), math.log1p(len(words))]


def _log_odds(pos: int, neg: int, n_pos: int, n_neg: int) -> float:
    """A low estimate of the log odds ratio: one standard error below the smoothed value."""
    value = math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
    return value - (1 / (pos + 0.5) + 1 / (neg + 0.5)) ** 0.5


def candidates(counts: list[tuple[str, bool, int, int]], n_pos: int, n_neg: int, least: float = 2.5) -> list[Term]:
    """Terms that at least three toxic texts have and whose low log odds reach ``least``, the best first."""
    scored = [Term(t, stem, v) for t, stem, pos, neg in counts if pos >= 3 and (v := _log_odds(pos, neg, n_pos, n_neg)) >= least]
    return sorted(scored, key=lambda t: (-t.weight, not t.stem, t.text))


def telling(counts: list) -> list:
    """Counts without stems that stand for one word or for a longer stem, and without words that a stem stands for.

    The words come back as spellings of their stem (``spelt``).
    """
    pos = {(c["term"], c["stem"]): c["pos0"] + c["pos1"] for c in counts}
    below: dict[str, int] = {}  # the most texts that one word, or one longer stem, of a stem has
    for (term, stem), n in pos.items():
        for size in (len(term) - 1,) if stem else STEM_LENGTHS:
            if size < len(term):
                below[term[:size]] = max(below.get(term[:size], 0), n if not stem else int(n * 1.2))
    stems = {t for (t, stem), n in pos.items() if stem and n > 1.3 * below.get(t, 0)}
    return [c for c in counts if (c["term"] in stems if c["stem"] else not any(len(c["term"]) > n and c["term"][:n] in stems for n in STEM_LENGTHS))]


def spelt(terms: list[Term], words: list[str]) -> list[Term]:
    """The terms, stems with those of the words that they stand for."""
    found: dict[str, list[str]] = {t.text: [] for t in terms if t.stem}
    for word in words:
        for n in STEM_LENGTHS:
            if len(word) > n and word[:n] in found:
                found[word[:n]].append(word)
    return [replace(t, words=tuple(sorted(found[t.text]))) if t.stem else t for t in terms]


def cover(terms: list[Term], texts: list[list[int]], depth: int = 4, least: int = 3) -> list[Term]:
    """The terms that it takes for every toxic text to have ``depth`` of them.

    ``texts`` has the positions of the terms in each text. Terms are taken from the best; one is left out if
    fewer than ``least`` of its texts still lack terms: words that happen to be in copies of toxic texts are
    as telling as its terms, but add nothing.
    """
    having: dict[int, list[int]] = {}
    for i, found in enumerate(texts):
        for t in found:
            having.setdefault(t, []).append(i)
    lacking, chosen = [depth] * len(texts), []
    for t, term in enumerate(terms):
        mine = [i for i in having.get(t, ()) if lacking[i] > 0]
        if len(mine) >= least:
            chosen.append(term)
            for i in mine:
                lacking[i] -= 1
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first coefficient is the unpenalised intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step * min(1, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    """Lexicon and coefficients; without both kinds of labels, a constant."""

    terms: tuple[Term, ...]
    coefficients: tuple[float, ...]
    #: The share of toxic labels: the score without coefficients, and the most that a text without a match can score.
    base: float
    #: The logarithm of the word count of the shortest text learned from.
    shortest: float = 0.0

    def score(self, text: str | None, matcher: Matcher) -> float:
        if not self.coefficients:
            return self.base
        x = features(text, matcher)
        unmatched = not any(x[:-1])
        if unmatched:  # what the fit says of length holds for lengths that it has seen
            x[-1] = max(x[-1], self.shortest)
        z = self.coefficients[0] + sum(a * b for a, b in zip(self.coefficients[1:], x))
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return min(p, self.base) if unmatched else p


def _term_counts(rows: DataFrame) -> DataFrame:
    """term, stem, and in how many toxic and other texts of each fold it occurs (pos0, neg0, pos1, neg1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores.release()
        for batch in batches:
            counts: dict[tuple[str, bool], list[int]] = {}
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                words = set(_WORDS.findall((text or "").lower()))
                stems = {w[:n] for w in words for n in STEM_LENGTHS if len(w) > n}
                for key in [*((w, False) for w in words), *((s, True) for s in stems)]:
                    counts.setdefault(key, [0, 0, 0, 0])[2 * fold + (not toxic)] += 1
            columns = list(zip(*((t, s, *c) for (t, s), c in counts.items()))) or [()] * 6
            kinds = [pa.string(), pa.bool_(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["term", "stem", "pos0", "neg0", "pos1", "neg1"])

    counts = rows.select("text", "toxic", "fold").mapInArrow(run, "term string, stem boolean, pos0 long, neg0 long, pos1 long, neg1 long")
    return counts.groupBy("term", "stem").agg(*[F.sum(c).alias(c) for c in ("pos0", "neg0", "pos1", "neg1")])


def _finder(lists: list[list[Term]]):
    """A task that tells which terms of each list a text has."""
    places = [{(t.text, t.stem): i for i, t in enumerate(terms)} for terms in lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], []]
            for text in batch.column("text").to_pylist():
                words = set(_WORDS.findall((text or "").lower()))
                keys = [*((w, False) for w in words), *{(w[:n], True) for w in words for n in STEM_LENGTHS if len(w) > n}]
                for column, place in zip(columns, places):
                    column.append(sorted(place[k] for k in keys if k in place))
            yield pa.RecordBatch.from_arrays([batch.column("fold"), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], names=["fold", "zero", "one", "both"])

    return run


def distinct_texts(rows: list) -> list[tuple]:
    """(toxic, _id, _t) of the rows that are no near copies of one before them: of one label, with half a sketch in common."""
    kept: list[tuple] = []
    having: dict[tuple[bool, int], list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["toxic"], r["_id"], r["_t"])):
        shared: dict[int, int] = {}
        for h in r["_s"]:
            for at in having.get((r["toxic"], h), ()):
                shared[at] = shared.get(at, 0) + 1
        if max(shared.values(), default=0) * 2 <= len(r["_s"]):
            for h in r["_s"]:
                having.setdefault((r["toxic"], h), []).append(len(kept))
            kept.append((r["toxic"], r["_id"], r["_t"]))
    return kept


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, sample: int = 4000, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model from labelled rows: ``labels`` has doc_id and toxic; ``learn_from`` tells the rows to use.

    At most ``sample`` toxic and ``sample`` other labelled rows are drawn, by a hash of the id.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull())
    if learn_from is not None:
        usable = usable.where(learn_from)
    usable = usable.select(F.col(doc_id).alias("_id"), (F.col("toxic") == 1).alias("toxic"), unit_hash(doc_id, seed=7).alias("_draw"))
    sizes = dict(usable.groupBy("toxic").count().collect())
    n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_neg:
        return Model((), (), n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.0)
    drawn = usable.where("toxic").orderBy("_draw", "_id").limit(sample).union(usable.where("not toxic").orderBy("_draw", "_id").limit(sample))
    read = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(drawn.distinct()), "_id")
    hashes = F.array_sort(F.array_distinct(shingle_hashes(F.coalesce("text", F.lit("")), 3)))
    read = read.select("_id", "text", "toxic", "_draw", F.xxhash64("text").alias("_t"), F.slice(hashes, 1, SKETCH).alias("_s")).persist()
    # one id may have many rows: no more than ``sample`` of each label go to the driver, as a few numbers each
    first = lambda label: read.where(label).select("toxic", "_draw", "_id", "_t", "_s").orderBy("_draw", "_id", "_t").limit(sample).collect()
    kept = distinct_texts(first("toxic") + first("not toxic"))
    key = ["toxic", "_id", "_t"]
    kept = from_driver(docs.sparkSession, kept, read.select(*key).schema)
    rows = read.join(F.broadcast(kept), key).dropDuplicates(key).select("text", "toxic", F.pmod(F.col("_s")[0], F.lit(2)).cast("int").alias("fold")).persist()
    all_counts = None
    try:
        totals = {(t, f): n for t, f, n in rows.groupBy("toxic", "fold").count().collect()}
        n = {k: totals.get(k, 0) for k in ((True, 0), (False, 0), (True, 1), (False, 1))}
        all_pos, all_neg = n[True, 0] + n[True, 1], n[False, 0] + n[False, 1]
        wanted = f"pos0 + pos1 >= 3 and (pos0 + pos1 + 0.5) / {all_pos + 1} >= 4 * (neg0 + neg1 + 0.5) / {all_neg + 1}"
        all_counts = _term_counts(rows).persist()
        counts = all_counts.where(wanted).orderBy(F.desc(F.expr("pos0 + pos1")), "term", "stem").collect()
        counts = telling(counts)
        lists = [
            candidates([(c["term"], c["stem"], c["pos1"], c["neg1"]) for c in counts], n[True, 1], n[False, 1]),
            candidates([(c["term"], c["stem"], c["pos0"], c["neg0"]) for c in counts], n[True, 0], n[False, 0]),
            candidates([(c["term"], c["stem"], c["pos0"] + c["pos1"], c["neg0"] + c["neg1"]) for c in counts], all_pos, all_neg),
        ]
        found = rows.where("toxic").select("text", "fold").mapInArrow(_finder(lists), "fold int, zero array<int>, one array<int>, both array<int>").collect()
        lexica = [  # for texts of fold 0, learned from fold 1; for fold 1; for texts that weren't seen
            cover(lists[0], [r["zero"] for r in found if r["fold"] == 1]),
            cover(lists[1], [r["one"] for r in found if r["fold"] == 0]),
            cover(lists[2], [r["both"] for r in found]),
        ]
        # the words of these stems, however rare, that toxic texts have more often than others
        stems = sorted({t.text for terms in lexica for t in terms if t.stem})
        stands = F.lit(False)
        for size in STEM_LENGTHS:
            stands |= (F.length("term") > size) & F.substring("term", 1, size).isin([t for t in stems if len(t) == size])
        words = all_counts.where(~F.col("stem") & (F.length("term") >= FUZZY_LENGTH) & stands).where(f"(pos0 + pos1) * {all_neg} >= 4 * (neg0 + neg1) * {all_pos}").collect()
        lexica = [
            spelt(lexica[0], [c["term"] for c in words if c["pos1"] * n[False, 1] >= max(1, 4 * c["neg1"] * n[True, 1])]),
            spelt(lexica[1], [c["term"] for c in words if c["pos0"] * n[False, 0] >= max(1, 4 * c["neg0"] * n[True, 0])]),
            spelt(lexica[2], [c["term"] for c in words if c["pos0"] + c["pos1"]]),
        ]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matchers = [Matcher(terms) for terms in lexica[:2]]
            for batch in batches:
                found = [features(t, matchers[f]) for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

        seen = rows.select("text", "toxic", "fold").mapInArrow(run, "x array<double>, toxic boolean").collect()
    finally:
        if all_counts is not None:
            all_counts.unpersist()
        rows.unpersist()
        read.unpersist()
    x, y = np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], float)
    if not len(y) or y.min() == y.max():
        return Model((), (), n_pos / (n_pos + n_neg))
    w = logistic(x, y)
    w[0] += math.log(n_pos / n_neg) - math.log(y.sum() / (len(y) - y.sum()))  # the sample has other shares than the labels
    return Model(tuple(lexica[2]), tuple(w.tolist()), n_pos / (n_pos + n_neg), float(x[:, -1].min()))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from one half)."""
    read, told = texts(df, text, "score", "predicted")
    schema = T.StructType([read.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores.release()
        matcher = Matcher(list(model.terms))
        for batch in portions(batches):
            scores = pa.array([model.score(t, matcher) for t in told(batch).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), scores], names=schema.names)

    return read.mapInArrow(run, schema).select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
