"""Stores of words in Python workers: kept from task to task, one at a time."""

import public_tokenizers
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Row
from pyspark.sql import functions as F

from spectrafold.llm import language_id, near_dedup, packing, stores, toxicity
from spectrafold.llm.queries import packed


def _held(spark):
    """The process and the stores (kind, identity) of each worker that answers."""

    def look(batches):
        import os

        for _ in batches:
            held = stores._held.items()
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "kinds": [[k[0] for k, _ in held]], "ids": [[id(v) for _, v in held]]})

    rows = spark.range(8, numPartitions=8).mapInArrow(look, "pid long, kinds array<string>, ids array<long>").collect()
    return {r["pid"]: (r["kinds"], r["ids"]) for r in rows}


def test_a_worker_keeps_one_store(spark):
    docs = spark.createDataFrame([(i, f"Some words of text {i}") for i in range(64)], "doc_id long, text string").repartition(8)
    pack = lambda: packing.pack(docs, public_tokenizers.path(packed.TOKENIZER)).count()
    assert pack() >= 64
    first = _held(spark)
    assert any(kinds == ["packing"] for kinds, _ in first.values())
    assert pack() >= 64
    second = _held(spark)
    # the same object: later tasks of a worker find what earlier ones made
    assert all(second[pid] == held for pid, held in first.items() if held[0] == ["packing"] and pid in second)
    near_dedup.sketches(docs, "doc_id", "text").count()
    third = _held(spark)
    assert all(len(kinds) <= 1 for kinds, _ in third.values())
    assert any(kinds == ["shingles"] for kinds, _ in third.values())


def _resident():
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) / 1024


def test_memory_of_earlier_tasks_is_given_back():
    texts = [f"{i} " * 500 for i in range(40_000)]
    texts = texts[::100]  # the rest is free, but in pieces
    before = _resident()
    stores.release()  # also without a store
    assert before - _resident() > 50
    assert len(texts) == 400


def test_a_text_is_sent_to_a_worker_once(spark):
    docs = spark.createDataFrame([(1, "Some words", "en", {"a": "other"})], "doc_id long, text string, `lang.of` string, map map<string,string>")
    for out in (language_id.predict(docs, None), toxicity.score(docs, toxicity.Model((), (), 0.0))):
        sent = out._jdf.queryExecution().analyzed().toString().split("MapInArrow")[1].split("\n")[1]
        assert sent.count("text#") == 1
        assert out.first()[:4] == (1, "Some words", "en", {"a": "other"})
    # texts that aren't a column of the rows as they are
    renamed = docs.select("doc_id", F.struct("text").alias("s"), F.col("text").alias("score"))
    assert toxicity.score(renamed, toxicity.Model((), (), 0.0), text="s.text").columns == ["doc_id", "s", "score", "predicted"]
    assert language_id.predict(renamed, None, text="score").first()[:2] == (1, Row(text="Some words"))


def test_learning_starts_no_workers_of_another_kind(spark, monkeypatch):
    lines = [(i, f"Some {'vile ' * (i % 2)}words of text {i}", "en") for i in range(40)]
    docs = spark.createDataFrame(lines, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")

    def refused(*_):
        raise AssertionError("an RDD of Python rows")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    assert language_id.learn(docs).languages == ("en",)
    assert 0 < toxicity.learn(docs, labels).base < 1
    # no document has a label
    assert toxicity.learn(docs, labels.withColumn("doc_id", F.col("doc_id") + 1000)).base == 0.5
