"""Language identification against a plain computation: runs of characters, TF-IDF, and follow-the-regularised-leader."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from spectrafold.llm import language_id


def test_letters_of_all_planes_are_letters():
    for letter in ("a", "é", "中", "\U00020000", "\U00030000", "\U00031350"):
        buckets, counts = language_id.grams(letter * 3)
        assert counts.sum() == 3 * 3 + 3 and len(buckets) > 3  # runs of one to three characters of " xxx "
    assert {tuple(language_id.grams(c)[0]) for c in ("\U00030000", "\U00030001", "\U00031350")} != {tuple(language_id.grams("\U00030000")[0])}
    assert language_id.grams("１２ 3 ...") is None


def plain_ftrl(samples, classes, alpha=0.5, beta=1.0, l1=0.02, l2=0.05):
    """The weights after each (features {bucket: x}, label) in turn, one coordinate at a time."""
    z, n = {}, {}

    def weight(i, k):
        zi = z.get((i, k), 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get((i, k), 0.0))) / alpha + l2)

    for x, label in samples:
        w = {(i, k): weight(i, k) for i in x for k in range(classes)}
        scores = [sum(v * w[i, k] for i, v in x.items()) for k in range(classes)]
        top = max(scores)
        e = [math.exp(s - top) for s in scores]
        for i, v in x.items():
            for k in range(classes):
                g = v * (e[k] / sum(e) - (k == label))
                before = n.get((i, k), 0.0)
                z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[i, k]
                n[i, k] = before + g * g
    return weight


def test_ftrl_equals_a_plain_one():
    rng = random.Random(3)
    samples = [({rng.randrange(40): rng.random() for _ in range(6)}, rng.randrange(3)) for _ in range(200)]
    ftrl = language_id.Ftrl(3)
    for x, label in samples:
        ftrl.learn(np.array(list(x)), np.array(list(x.values())), label)
    want = plain_ftrl(samples, 3)
    got = ftrl.weights(slice(0, 40))
    assert all(abs(got[i, k] - want(i, k)) < 1e-12 for i in range(40) for k in range(3))
    assert (got == 0).any() and (got != 0).any()


def test_document_frequencies_and_probabilities(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abcde" if i % 2 else "defgh") for _ in range(6)) for _ in range(8)), "xy"[i % 2]) for i in range(120)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    seen = np.zeros(language_id.BUCKETS)
    for _, text, _ in rows:
        seen[language_id.grams(text)[0]] += 1
    order = np.argsort(seen, kind="stable")
    assert (np.diff(model.idf[order[seen[order] > 0]]) <= 1e-9).all()  # the more documents, the less weight
    out = language_id.predict(spark.createDataFrame(rows * 2 + [(999, "word " * 200_000, None)], "doc_id long, text string, lang string"), model).collect()
    told = [r for r in out if r["doc_id"] != 999]
    assert sum(r["lang_pred"] == r["lang"] for r in told) == len(told) == 240
    w = np.zeros((language_id.BUCKETS + 1, 2))
    w[model.rows] = model.weights
    for r in told[:20]:
        buckets, counts = language_id.grams(r["text"])
        x = [(1 + math.log(c)) * model.idf[b] for b, c in zip(buckets, counts)]
        size = math.sqrt(sum(v * v for v in x))
        s = [(sum(v / size * w[b, k] for v, b in zip(x, buckets)) + 0.2 * w[-1, k]) / model.temperature for k in range(2)]
        p = math.exp(max(s)) / sum(map(math.exp, s))
        assert abs(p - r["score"]) < 1e-6 and model.languages[int(np.argmax(s))] == r["lang_pred"]


def test_equally_likely_languages(spark):
    rows = [(i, "same words here", "zy"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.predict(df, language_id.learn(df))
    assert out.where(F.col("score").between(0, 1)).count() == 40 and out.select("lang_pred", "score").distinct().count() == 1
