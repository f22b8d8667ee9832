"""The pipeline against plain versions of its stages, and its stages on odd tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_text_operators import plain_classes, plain_line_dedup
from test_toxicity import PlainMatcher
from tokenizers import Tokenizer

import corpus_pipeline
from spectrafold.llm import language_id, toxicity


def corpus(folder, spark, extra=False):
    """Two languages, toxic documents, repeated passages, copies, and odd rows."""
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 7)))
    vocabulary = {"xx": [word("abcde") for _ in range(300)], "yy": [word("klmno") for _ in range(300)]}
    passage = "\n".join(" ".join(rng.choices(vocabulary["xx"], k=8)) for _ in range(4))
    rows, labels = [], []
    for i in range(160):
        lang = "xx" if i % 2 else "yy"
        lines = [" ".join(rng.choices(vocabulary[lang], k=8)) for _ in range(8)]
        if i % 8 == 0:
            lines = [" ".join([x, rng.choice(["vileness", "grobnaken", "scoundrel"])]) for x in lines]
        text = "\n".join(lines)
        if i % 10 == 1:
            text += "\n" + passage
        if i % 20 == 7:
            text = rows[-2][1] if i % 40 == 7 else rows[-2][1].replace(rows[-2][1].split()[5], "changed", 1)
        rows.append((i, text, lang, "s", len(text)))
        labels.append((i, 1, int(i % 8 == 0)))
    if extra:
        rows += [(None, rows[3][1], "xx", None, None), (500, None, None, "s", 0), (501, "", "xx", "s", 0), (502, "123 !", "yy", "s", 5), rows[5], rows[5], (6, rows[9][1], "xx", "s", 1), (503, "aaaa bbbb " * 30_000, "xx", "s", 1)]
        labels += [(None, 1, 1), (5, None, None), (5, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_pipeline_equals_plain_stages(spark, tmp_path):
    docs = corpus(str(tmp_path), spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.learn(docs, labels, F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    matcher = PlainMatcher(list(model.terms))
    texts = {i: t for i, t in texts.items() if model.score(t, matcher) < 0.5}
    assert 120 <= len(texts) < 150
    left = docs.where(F.col("doc_id").isin(list(texts)))
    learned = language_id.learn(left, F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    dense = np.zeros((language_id.BUCKETS + 1, len(learned.languages)))
    dense[learned.rows] = learned.weights

    def certain(text):
        x = np.zeros(language_id.BUCKETS + 1)
        buckets, counts = language_id.grams(text)
        x[buckets] = (1 + np.log(counts)) * learned.idf[buckets]
        x /= np.linalg.norm(x)
        x[-1] = 0.2
        z = np.exp(x @ dense / learned.temperature)
        return z.max() / z.sum() >= corpus_pipeline.LEAST_CERTAIN

    texts = {i: t for i, t in texts.items() if certain(t)}
    texts = {i: t for i, t in plain_line_dedup(texts).items() if t}
    classes = plain_classes(texts)
    texts = {i: t for i, t in texts.items() if classes[i] == i}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        ids = want[r["doc_id"]]
        piece = ids[r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
    assert sum(r["length"] for r in got) == sum(map(len, want.values()))


def test_stages_on_odd_rows_and_names(spark, tmp_path):
    docs = corpus(str(tmp_path), spark, extra=True).withColumns({c: F.lit(c) for c in ("row", "score", "predicted", "_k", "tree", "nth", "label", "lang_pred", "n_lines")})
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        before = ids(docs)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert set(ids(out)) == set(before)
            continue
        assert out.columns == docs.columns and out.where("row <> 'row' or score <> 'score' or nth <> 'nth'").count() == 0
        after = ids(out)
        if name == "toxicity":
            assert {"None", "500", "501", "502", "503"} <= set(after) and after.count("5") == 3
        if name == "language_id":
            assert not {"500", "501", "502"} & set(after) and {"None", "503"} <= set(after)
        if name == "near_dedup":
            assert after.count("5") == 1 and "None" in after
        docs = out.persist()


@pytest.mark.parametrize("column", ["text", "lang", "source", "n_chars", "doc_id"])
def test_stages_with_a_column_of_nulls(spark, tmp_path, column):
    docs = corpus(str(tmp_path), spark)
    docs = docs.withColumn(column, F.lit(None).cast(docs.schema[column].dataType))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() >= 0
        if name != "packing":
            docs = docs.persist()
