"""Tokenizers, line dedup, fingerprints, near-duplicates and packing against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from spectrafold.llm import fingerprints, line_dedup, near_dedup, packing, piece_codec

ODD = ["", " ", "  ", "\n", " \n a", "a  b", "x▁y", "日本語", "🙂 é", "a" * 400, "\x00b", "foo\tbar", "a.b,c", "It's", "<s> </s>", ".,", "x ,y", "_._", "▁▁", "²."]


def random_texts(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def documents(spark, texts, extra=""):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_piece_codec_equals_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, library = piece_codec.PieceCodec(path, cache_size=50), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in [*ODD, *random_texts("ab .,_é日\n▁²!<>0x e", 1500, 1)]:
        ids = codec.encode(text)
        want = [1, *library.encode(text), 2]
        assert list(memoryview(ids).cast("I")) == want, text
        assert codec.decode(ids) == library.decode(want), text


def test_merging_equals_backtracking():
    codec = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    for text in random_texts("▁theringa", 300, 2):
        assert [codec.pieces[i] for i in codec.split(text)] == codec.merge(text)


def test_encode_keeps_columns_and_handles_nulls(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (2, None, "y")], "doc_id long, text string, decoded string")
    rows = piece_codec.encode(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(rows) == 3 and rows[0]["decoded"] == "a b" and bytes(rows[1]["piece_ids"]) == bytes([1, 0, 0, 0, 2, 0, 0, 0])
    assert piece_codec.encode(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_word_tokens_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    words, library = packing.WordTokens(path, 1, 300), Tokenizer.from_file(path)
    texts = [*ODD, "It's a DON'T.'s x", "<|endoftext|>a <|STARTOFTEXT|>", "ΣΑΣ, ΣΑΣ", "a b\x1cd\x85e", "foo.) (bar),", "a.. b, c_, d", *random_texts("aB ,.'’!s<|0é́日\n\t Σ", 1500, 3)]
    for start in range(0, len(texts), 40):
        for text, ids in zip(texts[start : start + 40], words.encode(texts[start : start + 40])):
            assert list(memoryview(ids).cast("I")) == [*library.encode(text, add_special_tokens=False).ids, 1], text


def plain_differencing(sizes, windows):
    """The descending window sums of Karmarkar-Karp, straight from its description; of equal ones the earlier made first."""
    parts = [(s, i, [s] + [0] * (windows - 1)) for i, s in enumerate(sizes)]
    for made in range(len(sizes), 2 * len(sizes) - 1):
        parts.sort(key=lambda p: (-p[0], p[1]))
        (_, _, one), (_, _, other) = parts.pop(0), parts.pop(0)
        merged = sorted((a + b for a, b in zip(one, reversed(other))), reverse=True)
        parts.append((merged[0] - merged[-1], made, merged))
    return parts[0][2]


def test_differencing_equals_its_description():
    rng = random.Random(4)
    for windows in (2, 3, 8, 30):
        for n in (1, 2, 40, 150):
            sizes = [rng.randint(1, 3000) for _ in range(n)]
            held = packing.differencing(sizes, windows)
            assert sorted(i for w in held for i in w) == list(range(n))
            assert sorted((sum(sizes[i] for i in w) for w in held), reverse=True) == plain_differencing(sizes, windows)
    assert packing.differencing([], 2) == [[], []] and packing.differencing([5, 4], 1) == [[0, 1]]


def test_the_window_count_rises_until_all_windows_hold():
    rng = random.Random(5)
    for high in (300, 1100, 2048):
        sizes = [rng.randint(1, high) for _ in range(120)]
        pieces = [(i, 0, s) for i, s in enumerate(sizes)]
        least = -(-sum(sizes) // 2048)
        for cut in (True, False):
            windows = packing.pack_group(pieces, 2048, cut)
            assert all(0 < sum(p[2] for p in w) <= 2048 for w in windows)
            assert sorted((d, s + k) for w in windows for d, s, n in w for k in range(n)) == [(d, k) for d, _, n in pieces for k in range(n)]
            assert len(windows) == least if cut else len(windows) >= least
    pieces = [(i, 0, 1500) for i in range(40)]
    assert len(packing.pack_group(pieces, 2048, False)) == 40 and len(packing.pack_group(pieces, 2048, True)) == 30


def test_the_count_rises_on_the_way_of_the_query(monkeypatch):
    tried = []
    plain = packing.differencing
    monkeypatch.setattr(packing, "differencing", lambda sizes, windows: tried.append(windows) or plain(sizes, windows))
    packer, rng = packing.Packer(2048, 64), random.Random(6)
    sequences = [s for d in range(3000) for s in packer.add(d, rng.randint(1, 900))] + list(packer.end())
    assert max(tried) > 64  # full groups of 64 windows' tokens need more windows before any cut
    lengths = [sum(p[2] for p in s) for s in sequences]
    padding = sum(2048 - n for n in lengths if n & (n - 1))
    assert padding == 0 and max(lengths) == 2048


def test_packing_covers_every_token(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["hello", "world", "tokens", "ü"]) for _ in range(rng.choice([0, 3, 400, 5000]))) for _ in range(40)] + [None]
    rows = packing.pack(documents(spark, texts).repartition(2), path, group_windows=4).collect()
    library = Tokenizer.from_file(path)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for doc, group in itertools.groupby(sorted(rows, key=lambda r: (r["doc_id"], r["start"])), lambda r: r["doc_id"]):
        got = [i for r in group for i in memoryview(bytes(r["piece_ids"])).cast("I")]
        assert got == want.pop(doc)
    assert not want
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0 or at > 2048 - 2048 // 4


def plain_line_dedup(docs):
    first, gone = {}, {i: set() for i in docs}
    for i in sorted(docs):
        lines = (docs[i] or "").split("\n") if docs[i] is not None else []
        for p in range(len(lines) - 2):
            if first.setdefault(tuple(lines[p : p + 3]), (i, p)) != (i, p):
                gone[i].update((p, p + 1, p + 2))
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in docs.items()}


def test_line_dedup(spark):
    rng = random.Random(6)
    texts = ["\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "", "one", "a\na\na\na\na"]
    df = documents(spark, texts).selectExpr("*", "'kept' as n_lines", "1 as other")
    rows = line_dedup.dedup_lines(df).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == plain_line_dedup(dict(enumerate(texts)))
    assert set(rows[0].asDict()) == {"doc_id", "text", "other", "n_lines", "n_removed"}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    again = line_dedup.dedup_lines(df.union(df)).collect()  # equal rows are one document
    assert len(again) == 2 * len(texts) and {r["doc_id"]: r["text"] for r in again} == plain_line_dedup(dict(enumerate(texts)))


def plain_sketch(text):
    words = re.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower()).strip(" ").split(" ")
    out = set()
    for i in range(max(1, len(words) - 4)):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.add(h - (1 << 64) if h >> 63 else h)
    low = {h for h in out if h < -(1 << 63) + (1 << 62)}
    return sorted(low) if low else [min(out)]


def test_fingerprints(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("the of and to in is on by at it".split()) for _ in range(rng.choice([0, 2, 5, 80]))) for _ in range(30)] + [None, "é日 x"]
    rows = {r["doc_id"]: r for r in fingerprints.compare_with_next(documents(spark, texts)).collect()}
    order = sorted(rows, reverse=True)
    for at, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[i]["edited_text"] == edited
        assert rows[i]["sketch"] == plain_sketch(text) and rows[i]["edited_sketch"] == plain_sketch(edited) and rows[i]["next_sketch"] == plain_sketch(after)
    assert fingerprints.compare_with_next(documents(spark, ["a b"])).count() == 1
    assert fingerprints.compare_with_next(documents(spark, ["a b"]).limit(0)).count() == 0
    twice = documents(spark, texts).union(documents(spark, texts))
    assert fingerprints.compare_with_next(twice).count() == len(texts)
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (3, "c")], "doc_id long, text string")
    assert fingerprints.compare_with_next(nulls).count() == 3


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(docs):
    sets, label = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}
    for a, b in itertools.combinations(sorted(docs), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    return label


def test_near_duplicates(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for size in (1, 1, 2, 5, 60):
        base = [word() for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 8])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [texts[0], None, "", "", "one two", "one two", "!!"]
    docs = dict(enumerate(texts))
    rows = near_dedup.near_duplicates(documents(spark, texts)).collect()
    want = plain_classes(docs)
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert sum(got[i] != want[i] for i in docs) <= 1  # pairs on the threshold may be missed by chance
    assert near_dedup.near_duplicates(documents(spark, texts).limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted(str(r["class_id"]) for r in near_dedup.near_duplicates(nulls).collect()) == ["1", "1", "None"]


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(100, 101), (102, 101)], "a long, b long")
    got = dict(near_dedup.components(links).collect())
    assert {k: v for k, v in got.items() if k < 50} == {i: 0 for i in range(31)} and got[102] == 100


@pytest.mark.parametrize("text", ["a", "ü"])
def test_digests_of_packed_ids(text):
    ids = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"), 1).encode([text])[0]
    assert zlib.crc32(ids) >= 0 and hashlib.sha256(ids).hexdigest()


def test_packing_of_odd_tables(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, "hello world", 5, "s")] * 2 + [(1, "other", None, None), (None, "null id", 1, "x"), (2, None, 2, "y"), (3, "", 3, ""), (4, "long text " * 60_000, 4, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long, sequence_id string")
    got = packing.pack(df, path).collect()
    library = Tokenizer.from_file(path)
    want = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _, _ in rows)
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in got if r["start"] == 0) == want
    assert sum(r["length"] for r in got) == sum(n for _, n in want)
    assert packing.pack(df.limit(0), path).count() == 0
    lengths = {}
    for r in got:
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    assert all(n <= 2048 for n in lengths.values()) and sum(2048 - n for n in lengths.values() if n & (n - 1)) <= 0.02 * sum(n for _, n in want)


def test_packing_ids_equal_the_library_on_odd_text():
    """Letters that normalise to letter and mark, marks, controls, separators and special tokens, in any order."""
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    words, library = packing.WordTokens(path, 1, 5000), Tokenizer.from_file(path)
    signs = [*"abcXYZ é ß İ ı ,.!?;:' - _ 1 2 ½ ² ª µ Σ ς ǅ ﬁ ẞ Å 中 א 한 각 😀 ’ … ·", "क़", "שׁ", "שׁ", "́", "̇", "ͅ", "ẛ̣"]
    signs += ["\x1c", "\x1f", "\x85", "\xa0", "​", "\xad", " ", "\t", "\n", "<|startoftext|>", "<|endoftext|>", "<|", "|>", "'s", "I'M", ", ", ". ", "! "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 24))) for _ in range(5000)] + ["İ.", "SEDEFİ, x", "क़, a", "שׁ. a", "\x1c, b", "-, b"]
    for text, ids, found in zip(texts, words.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert list(memoryview(ids).cast("I")) == found.ids + [1], repr(text)
