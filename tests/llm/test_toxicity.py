"""Toxicity: misspelt terms, quotations, near copies in the sample, and odd tables."""

import random

import pytest
from pyspark.sql import functions as F

from spectrafold.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class PlainMatcher:
    """Words and terms compared one by one by edit distance."""

    def __init__(self, terms):
        self.terms, self.known = terms, {}

    def match(self, word):
        for t in self.terms:
            if not t.stem and t.text == word:
                return t, True
        stems = [t for t in self.terms if t.stem and len(word) > len(t.text) and word.startswith(t.text)]
        if stems:
            return max(stems, key=lambda t: t.weight), True
        near = [t for t in self.terms for s in (t.words if t.stem else (t.text,)) if len(s) >= toxicity.FUZZY_LENGTH and s.isalpha() and distance(s, word) <= 1]
        return (max(near, key=lambda t: t.weight), False) if near else None


def misspelt(word, rng):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + "x" + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + "q" + word[i:]])


def corpus(seed=3, n=600):
    rng = random.Random(seed)
    bad = ["nastiness", "grobnaken", "vileness", "rottenly", "scoundrel", "grobnaker"]
    clean = ["w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(clean, k=30), i % 6 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return bad, clean, rows, labels


def test_the_automaton_finds_misspelt_terms(spark):
    bad, clean, rows, labels = corpus()
    rng = random.Random(8)
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    planted = [" ".join(rng.choices(clean, k=20) + [misspelt(w, rng) for w in rng.sample(bad, 4)]) for _ in range(60)]
    whole, without = toxicity.Matcher(list(model.terms)), toxicity.Matcher(list(model.terms))
    without.halves, without.half_lengths = set(), []
    recall = lambda m: sum(model.score(t, m) >= 0.5 for t in planted) / len(planted)
    assert recall(whole) >= 0.95 and recall(without) <= 0.5
    assert all(model.score(t, whole) < 0.5 for i, t in rows if i % 6)
    plain = PlainMatcher(list(model.terms))
    for text in planted + [t for _, t in rows[:60]]:
        assert model.score(text, whole) == pytest.approx(model.score(text, plain), abs=1e-12)


@pytest.mark.parametrize(
    ("text", "quoted"),
    [
        ("you’re a stupid person and it’s true", False),
        ("you're a stupid person and it's true", False),
        ("a ‘stupid’ b", True),
        ("“so stupid”", True),
        ("„so stupid“ und «so»", True),
        ("»so stupid«", True),
        ('he is "stupid" ok', True),
        ("”closed before stupid opened after“", False),
        ("“a quotation” then stupid then “another”", False),
        ("“never closed and stupid", False),
        ("“one paragraph\n\n stupid” next", False),
        ("“one\nline stupid” next", True),
        ("she wrote stupid things", True),
        ("‘it’s a stupid one’", True),
    ],
)
def test_quotations(text, quoted):
    x = toxicity.features(text, toxicity.Matcher([toxicity.Term("stupid", False, 4.0)]))
    assert (x[3] > 0, x[0] > 0) == (quoted, not quoted)


def test_near_copies_count_once_whatever_the_order(spark):
    rng = random.Random(5)
    base = ["w" + str(rng.randrange(10**6)) for _ in range(60)]
    rows, labels = [], []
    for i in range(120):  # 60 near copies of one toxic text, whose words must not become terms
        words = list(base) if i < 60 else ["c" + str(rng.randrange(2000)) for _ in range(60)]
        words[rng.randrange(60)] = "v" + str(i)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i < 60)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    assert model.terms == ()
    bad, _, rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.learn(docs, marks) == toxicity.learn(docs.orderBy(F.rand(1)).repartition(7), marks.repartition(3))


def test_odd_tables(spark):
    bad, clean, rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "a", 0.5, "x") for i, t in rows] + [(1, rows[1][1], "a", 0.5, "x"), (0, "another text", None, None, None), (None, " ".join(bad), "b", 1.0, None), (9000, None, None, None, None), (9001, "", "", 0.0, ""), (9002, "clean " * 100_000 + " ".join(bad), "", 0.0, "")], "doc_id long, text string, row string, score double, toxic string")
    marks = spark.createDataFrame([*labels, (0, 1), (0, 0), (None, 1), (5, None), (77_777, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "row", "toxic", "score", "predicted"] and out.count() == len(rows) + 6
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[None]["predicted"] == 1 and got[9000]["predicted"] == got[9001]["predicted"] == 0 and 9002 in got
    assert got[9000]["row"] is None and got[6]["row"] == "a" and all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.learn(docs.limit(0), marks)
    assert toxicity.score(docs.limit(3), nothing).where("score between 0 and 1").count() == 3


@pytest.mark.parametrize("share", [2, 3, 6, 20])
def test_texts_without_a_match_score_at_most_the_base_rate(spark, share):
    bad, clean, rows, _ = corpus()
    rng = random.Random(share)
    rows = [(i, " ".join(rng.choices(clean, k=rng.randrange(12, 60)) + rng.sample(bad, 3) * (i % share == 0))) for i in range(240)]
    labels = [(i, int(i % share == 0)) for i, _ in rows]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    matcher = toxicity.Matcher(list(model.terms))
    assert model.coefficients and model.base == pytest.approx(sum(y for _, y in labels) / len(labels))
    for text in (None, "", "...", "unseen", "unseen words only", "unseen " * 5000):
        assert model.score(text, matcher) <= model.base and model.score(text, matcher) < 0.5
    empty = toxicity.learn(spark.createDataFrame([(i, "") for i, _ in rows], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert toxicity.Matcher(list(empty.terms)) and empty.score("", toxicity.Matcher([])) <= empty.base + 1e-9
