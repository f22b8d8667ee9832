"""The alignment of two tokenizers against a plain one, made with both libraries."""

import hashlib
import random
from collections import Counter
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spectrafold.llm import token_alignment
from spectrafold.llm.queries import aligned

A, B = (public_tokenizers.path(n) for n in (aligned.A, aligned.B))
SIGNS = [*"abcXYZ éßİı,.!?;:-_12½²ªµ中한😀’'", "क़", "שׁ", "́", "\x1c", "\x1f", "\x85", "\xa0", "​", "\xad", "\t", "\n", "\n\n", "<|endoftext|>", "<|"]
SIGNS += ["<s>", "</s>", "<unk>", "<0x41>", "'s", " 'll", "I'M", " ", " ", " ", "  ", "   ", ", ", ". ", "! ", " \n", "\r\n", "\r", " ", "　", "the ", "ing", "\x00"]


@pytest.fixture(scope="module")
def plain():
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    shown = token_alignment.ByteTokens(A, plain=True).token_bytes

    def align(text):
        """groups, n_a, n_b and the linked pairs of ids, by comparing ends one by one; None without tokens."""
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        a_bytes = [shown[i] for i in a]
        b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            return None
        a_ends, b_ends = (dict(zip(np.cumsum([len(x) for x in all_]).tolist(), range(1, len(all_) + 1))) for all_ in (a_bytes, b_bytes))
        cuts = [(a_ends[e], b_ends[e]) for e in a_ends if e in b_ends]
        groups = [(a[p:q], b[r:s]) for (p, r), (q, s) in pairwise([(0, 0), *cuts])]
        return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups), len(a), len(b), [(a[p - 1], b[r - 1]) for p, r in cuts]

    return align


def plain_rows(docs, plain):
    """The rows of the query, from the plain alignment of all texts."""
    made = [(doc, plain(text)) for doc, text in docs]
    counts = Counter(link for _, x in made if x for link in x[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    for doc, x in made:
        links = x[3] if x else []
        yield (
            doc, x[1] if x else 0, x[2] if x else 0, len(links), len(links), sum(counts[link] == most[link[1]] for link in links),
            sum(counts[link] for link in links), hashlib.sha256(x[0].encode()).hexdigest() if x else "",
        )


def test_parts_give_what_whole_texts_give(plain):
    rng, aligner = random.Random(5), token_alignment.Aligner(A, B, cache_size=2000)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(24))) for _ in range(4000)] + ["a▁b", "▁", "one two, three. Four\nfive  six " * 500, "x" * 2000]
    for start in range(0, len(texts), 200):
        chunk = texts[start : start + 200]
        for text, (groups, packed, n_a, n_b) in zip(chunk, aligner.align(chunk)):
            keys = np.frombuffer(packed, aligner.key_type).astype(np.int64)
            got = (groups.decode(), n_a, n_b, list(zip((keys // 32_000).tolist(), (keys % 32_000).tolist()))) if n_a else None
            assert got == plain(text), repr(text[:40])


def test_owners():
    a, b = np.array([2, 3, 1]), np.array([1, 1, 4])
    assert token_alignment.overlaps(a, b).tolist() == [[0, 0], [0, 1], [1, 2], [2, 2]]
    assert [x.tolist() for x in token_alignment.links(a, b)] == [[0, 2], [1, 2]]


def test_query_against_plain(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = aligned.op11_token_alignment(spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_rows(docs, plain))


def test_odd_tables(spark, plain):
    rows = [(1, None), (2, ""), (3, "a▁b"), (4, "the cat, the dog"), (4, "the cat, the dog"), (None, "null id"), (5, " "), (6, "<s> <|endoftext|>"), (7, "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    crowded = df.select("*", *[F.lit("x").alias(c) for c in ("row", "groups", "n_best", "link_keys", "best", "n")])
    out = token_alignment.align(crowded, A, B)
    assert out.columns == ["doc_id", "row", "n_best", "best", "n", "n_a", "n_b", "n_groups", "groups", "link_keys", "link_times"]
    weighed = token_alignment.weigh(out, token_alignment.link_counts(out, *aligned.SIZES), *aligned.SIZES)
    got = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_groups"], r["n_best"], r["count_sum"], hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "") for r in weighed.collect()]
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=order) == sorted(plain_rows(rows, plain), key=order)
    nothing = token_alignment.align(df.limit(0), A, B)
    assert token_alignment.weigh(nothing, token_alignment.link_counts(nothing, *aligned.SIZES), *aligned.SIZES).count() == 0
