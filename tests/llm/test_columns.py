"""Columns of any name, equal rows, long values, empty tables: what each operator keeps and gives."""

import hashlib
import random
from datetime import date

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spectrafold.llm import fingerprints, html_text, language_id, line_dedup, near_dedup, packing, piece_codec, topk_search, toxicity, url_lists
from spectrafold.llm.queries import native

#: Names that operators use inside, or that other operators add.
CLASHES = "_k _l _a _b _d _w _t _id _page _host _starts _left row tree label a b c d i k l n t u v w at doc text_ host page key pattern_ history first pos lines starts left hit nth band bucket set_a bands words score_ Draw".split()


def crowded(df):
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.col(df.columns[0]).cast("string")).alias(c) for c in CLASHES])


def operators(spark):
    docs = spark.createDataFrame([(1, "one two\nthree four\nfive"), (2, None), (2, None), (3, ""), (4, "one two\nthree four\nfive\nsix"), (None, "x y")], "doc_id long, text string")
    pages = spark.createDataFrame([(1, "http://h.test/a", "<p>a</p>"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None)], "vec_id long, embedding array<double>")
    entries = spark.createDataFrame([("h.test", date(2024, 1, 1), "add")], "pattern string, day date, action string")
    model = toxicity.Model((toxicity.Term("three", False, 3.0),), (-1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0), 0.0)
    learned = language_id.learn(docs.withColumn("lang", F.lit("xx")))
    yield "op1", pages, html_text.extract, True
    yield "op2", docs, lambda d: language_id.predict(d, learned), True
    yield "op3", docs, line_dedup.dedup_lines, True
    yield "op4", docs, fingerprints.compare_with_next, False
    yield "op5", vectors, lambda d: topk_search.top_k(d, F.col("vec_id") % 50 == 0), False
    yield "op6", docs, lambda d: piece_codec.encode(d, public_tokenizers.path("piece_bpe_32k.model")), True
    yield "op7", docs, lambda d: toxicity.score(d, model), True
    yield "op8", docs, lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")), False
    yield "op9", docs, near_dedup.first_of_each, True
    yield "op10", pages.withColumn("fetched", F.lit("2024-02-01").cast("date")), lambda d: url_lists.evaluate(d, entries), True


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_names_of_other_columns_do_not_matter(spark, name):
    _, plain, run, keeps = next(x for x in operators(spark) if x[0] == name)
    one, other = run(plain), run(crowded(plain))
    key = lambda df: sorted(str(tuple(r[c] for c in one.columns)) for r in df.collect())
    assert key(one) == key(other)
    if keeps:
        rows = other.collect()
        assert set(CLASHES) <= set(other.columns)
        assert all(r[c] == (None if r[plain.columns[0]] is None else f"{c}:{r[plain.columns[0]]}") for r in rows for c in CLASHES)
    assert run(plain.limit(0)).count() == run(crowded(plain).limit(0)).count() == 0


def test_language_sample_is_bounded(spark, monkeypatch):
    """Null ids, one hot id, one hot language: no more rows than the bounds go to the driver."""
    rng = random.Random(1)
    texts = {k: ["".join(rng.choice(letters) for _ in range(8)) + " " + "".join(rng.choice(letters) for _ in range(8)) for _ in range(400)] for k, letters in (("xx", "abcd"), ("yy", "efgh"), ("zz", "ijkl"))}
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t, k) for k, ts in texts.items() for i, t in enumerate(ts)]
    seen = []
    plain = language_id.train
    monkeypatch.setattr(language_id, "train", lambda samples, languages, idf: seen.append(len(samples)) or plain(samples, languages, idf))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, sample=40)
    assert 100 <= seen[-1] <= 120
    language_id.learn(docs, sample=40, total=30)
    assert seen[-1] <= 30
    told = language_id.predict(docs, model).where("lang_pred = lang").count()
    assert told >= 0.99 * len(rows)
    tied = language_id.predict(spark.createDataFrame([("zzzz qqqq " * 50_000,)], "text string"), model)
    assert tied.first()["lang_pred"] in texts


def test_merged_sketches_are_sketches_of_the_whole(spark):
    rng = random.Random(2)
    rows = [(i, [" ".join(rng.choice("abcdef") * 3 for _ in range(rng.choice([1, 2, 5, 6, 9]))) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, parts array<string>")
    every = df.select("id", F.explode("parts").alias("p")).groupBy("id").agg(F.collect_list(fingerprints.sketch(F.col("p"))).alias("s"), F.flatten(F.collect_list(fingerprints.shingle_hashes(F.col("p")))).alias("h"))
    limit = -(1 << 63) + (1 << 62)
    fallen = 0
    for r in every.select(fingerprints.merge(F.col("s")).alias("got"), "h", "s").collect():
        low = sorted({h for h in r["h"] if h < limit})
        assert r["got"] == (low or [min(r["h"])])
        fallen += any(len(s) == 1 and s[0] >= limit for s in r["s"])
    assert fallen > 10


def test_query_columns_of_fingerprints(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("the of and to in is".split()) for _ in range(rng.choice([0, 3, 30]))) for _ in range(25)] + [None, "é日 x" * 7]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in native.op4_fingerprints(spark, str(tmp_path)).collect()}
    sketches = {}

    def sketch(text):
        if text not in sketches:
            sketches[text] = set(spark.range(1).select(fingerprints.sketch(F.lit(text)).alias("s")).first()["s"])
        return sketches[text]

    hexed = lambda s: ",".join(format(h & (1 << 64) - 1, "x") for h in sorted(s))
    like = lambda a, b: len(a & b) / min(len(a), len(b))
    for i, text in enumerate(texts):
        text, after = text or "", texts[i - 1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == hexed(sketch(text)) and r["edited_fingerprint"] == hexed(sketch(edited))
        assert r["near_edited"] == like(sketch(text), sketch(edited)) and r["near_next"] == like(sketch(text), sketch(after))


def test_hosts_in_numbers_and_long_urls(spark):
    day = date(2024, 1, 1)
    long = "/".join(["seg"] * 3000)
    entries = spark.createDataFrame([(p, day, "add") for p in ("7", "com", "0.7", "10.0.0.8", "x.org/seg/seg", "[::1]", "b.a", "y.org/" + long)], "pattern string, day date, action string")
    cases = {"http://10.0.0.7/": None, "http://10.0.0.8/q": "10.0.0.8", "http://a.com/": "com", "http://x.org/" + long: "x.org/seg/seg", "http://[::1]:80/": "[::1]", "http://b.a/": "b.a", "http://a.b/": None, "http://y.org/" + long + "/z": "y.org/" + long, "http://com.org": None, "http://x.org/seg": None}
    got = url_lists.evaluate(spark.createDataFrame([(u, day) for u in cases], "url string, fetched date"), entries)
    assert {r["url"]: r["pattern"] for r in got.collect()} == cases


def test_lines_of_any_length(spark):
    big = "\n".join(["same"] * 30_000)
    rows = line_dedup.dedup_lines(spark.createDataFrame([(1, big), (2, "x" * 2_000_000), (3, "y\n" * 2)], "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], len(r["text"])) for r in rows}
    assert got == {1: (30_000, 29_999, 4), 2: (1, 0, 2_000_000), 3: (3, 0, 4)}


def test_pieces_of_long_texts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    text = "long text ü " * 30_000 + "a" * 5000
    row = piece_codec.encode(spark.createDataFrame([(text,)], "text string"), path).first()
    assert list(memoryview(bytes(row["piece_ids"])).cast("I")) == [1, *sentencepiece.SentencePieceProcessor(model_file=path).encode(text), 2]
