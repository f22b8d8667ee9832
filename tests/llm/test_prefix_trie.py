"""The conversation trie against a plain one, as it is and rebuilt."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spectrafold.llm import prefix_trie
from spectrafold.llm.queries import conversations

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(paths):
    """The nodes of {conversation: [(role, text)]}, by walking every prefix."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(paths):
        for d in range(len(paths[conv]) + 1):
            members[tuple(paths[conv][:d])].append(conv)
        ends[tuple(paths[conv])].append(conv)
    saved, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        own = (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += not children[node]
    return sorted(
        (c[0], len(n), members[n[:-1]][0] if n else None, len(c), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n, c in members.items()
    )


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def told(rows):
    """{conversation: turns in order} of (conv_id, turn, role, text) rows."""
    def key(r):
        role, text = r[2] or "", r[3] or ""
        return (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest())

    out = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        out[r[0]].append((r[2] or "", r[3] or ""))
    return out


def conversation_rows(seed, count, longest, ids):
    rng = random.Random(seed)
    rows, before = [], []
    for conv in rng.sample(ids, count):
        turns = list(rng.choice(before))[: rng.randrange(longest)] if before and rng.random() < 0.7 else []
        turns += [(rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "é" * 3, "", None, "long text " * 9, "b"])) for _ in range(rng.randrange(longest if rng.random() < 0.2 else 4))]
        turns = turns or [(None, None)]
        before.append(turns)
        rows += [(conv, rng.choice([None, t]) if t == 0 else t, *x) for t, x in enumerate(turns)]
    rows += rows[:3] + [(None, 1, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "count", "longest"), [(1, 40, 20), (2, 60, 70)])
def test_against_a_plain_trie(spark, monkeypatch, seed, count, longest):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "IDS", 30)
    rows = conversation_rows(seed, count, longest, range(100))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit(7)).withColumn("name", F.lit("x"))
    assert rows_of(prefix_trie.conversation_trie(df)) == plain_trie(told(rows))


@pytest.mark.parametrize("seed", [3, 4])
def test_rebuilt_conversations(spark, tmp_path, seed):
    rows = conversation_rows(seed, 50, 14, range(80))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    turns, paths = told(rows), {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    assert any(not p for p in paths.values())
    assert rows_of(conversations.op13_conversation_trie(spark, str(tmp_path))) == plain_trie(paths)


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.conversation_trie(empty).count() == 0
    one = spark.createDataFrame([(5, None, None, None)], SCHEMA)
    assert rows_of(prefix_trie.conversation_trie(one)) == plain_trie({5: [("", "")]})
    turns = spark.createDataFrame([], "conv long, pos long, key binary, size long")
    assert rows_of(prefix_trie.trie(turns, spark.createDataFrame([(3,), (9,)], "conv long"))) == plain_trie({3: [], 9: []})
    copies = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    assert rows_of(prefix_trie.conversation_trie(spark.createDataFrame(copies, SCHEMA))) == plain_trie(told(copies))
