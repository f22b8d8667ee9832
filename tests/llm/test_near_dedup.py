"""ProbMinHash near-duplicates: the measure, recall against all pairs, ids and odd rows."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np

from spectrafold.llm import near_dedup


def bag(text):
    words = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def plain_similarities(one, other):
    """Probability Jaccard and Jaccard similarity of two bags, from their definitions."""
    every, both = one.keys() | other.keys(), one.keys() & other.keys()
    weighted = sum(1 / sum(max(one[y] / one[z], other[y] / other[z]) for y in every) for z in both)
    return weighted, len(both) / len(every)


def test_probability_jaccard_equals_its_definition():
    rng = random.Random(1)
    for _ in range(60):
        one, other = (Counter(rng.choices(range(1, 25), k=rng.randint(1, 60))) for _ in range(2))
        arrays = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], float)) for c in (one, other)]
        assert abs(near_dedup.probability_jaccard(*arrays[0], *arrays[1]) - plain_similarities(one, other)[0]) < 1e-9


def test_registers_estimate_probability_jaccard():
    rng, near = random.Random(2), []
    for _ in range(20):
        one = Counter({rng.getrandbits(60): rng.randint(1, 4) for _ in range(80)})
        other = Counter({k: v if rng.random() < 0.8 else rng.randint(1, 4) for k, v in one.items() if rng.random() < 0.9})
        docs = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], float)) for c in (one, other)]
        owner = near_dedup.prob_minhash(docs, 1024)
        near.append((owner[0] == owner[1]).mean() - plain_similarities(one, other)[0])
    assert abs(np.mean(near)) < 0.01 and np.abs(near).max() < 0.06


def test_recall_against_all_pairs(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    bags = {r["doc_id"]: bag(r["text"]) for r in docs.select("doc_id", "text").collect()}
    shared = defaultdict(Counter)
    having = defaultdict(list)
    for i, b in bags.items():
        for s in b:
            having[s].append(i)
    for ids in having.values():
        for a, b in itertools.combinations(sorted(ids), 2):
            shared[a][b] += 1
    label = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    links = [(a, b) for a, found in shared.items() for b, n in found.items() if n >= 0.8 * (len(bags[a]) + len(bags[b]) - n)]
    assert len(label) == len(bags) and len(links) > 50
    assert sum(label[a] == label[b] for a, b in links) >= 0.99 * len(links)
    # a class holds nothing that no link joins to it
    linked = {frozenset(p) for p in links}
    for a, b in itertools.combinations([i for i in label], 2):
        if label[a] == label[b] and frozenset((a, b)) not in linked:
            assert any(frozenset((a, c)) in linked for c in label if label[c] == label[a])


def test_weighted_copies_are_linked(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line, rows = [word() for _ in range(9)], []
    for i in range(6):  # a long repeated line, and other endings: similar by weight only
        rows.append((i, " ".join(line * 40 + [word() for _ in range(12)])))
    bags = [bag(t) for _, t in rows]
    weighted, plain = plain_similarities(bags[0], bags[1])
    assert weighted >= 0.8 > plain
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in near_dedup.near_duplicates(df).collect()} == {0}


def test_odd_rows_and_names(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [("b", "one two three", 1, "x", 5)] * 2 + [("a", "One  two, three", 2, None, None), (None, "one two three", 3, "y", 1), ("c", None, 4, "", 2), ("d", "", 5, "z", 3), ("e", long, 6, "q", 0), ("f", long + " end", 7, "q", 0)]
    df = spark.createDataFrame(rows, "doc_id string, text string, doc int, label string, nth int")
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_dedup.near_duplicates(df).collect())
    assert got == [("None", "None"), ("a", "a"), ("b", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "e"), ("f", "e")]
    kept = near_dedup.first_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["None", "a", "c", "d", "e"]
    assert near_dedup.first_of_each(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (1, "c d", 2), (2, "c d", 3)], "doc_id int, text string, n int")
    assert sorted(tuple(r) for r in near_dedup.first_of_each(twice).collect()) == [(1, "a b", 1), (1, "c d", 2)]
    assert twice.schema == near_dedup.first_of_each(twice).schema


def test_large_groups_of_copies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows = [word() for _ in range(200)], []
    for i in range(60):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(200)] = word()
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, rows[0][1]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in near_dedup.near_duplicates(df).collect()} == {0}


def test_files_are_freed_in_each_round(spark, monkeypatch):
    rounds, freed, spread, free = [], [], near_dedup._spread, near_dedup.free
    monkeypatch.setattr(near_dedup, "_spread", lambda *a: rounds.append(1) or spread(*a))
    monkeypatch.setattr(near_dedup, "free", lambda session: freed.append(1) or free(session))
    links = spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long")
    assert {(r["node"], r["label"]) for r in near_dedup.components(links).collect()} == {(i, 0) for i in range(7)}
    assert len(freed) == len(rounds) > 1
