"""Byte-level ids against the library, and token files: round trip, order, index, Bloom filters, odd tables."""

import random
import tracemalloc
import zlib
from array import array
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spectrafold.llm import byte_tokens, token_files
from spectrafold.llm.queries import token_output

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [*"abcXYZ éßİı,.!?;:-_12½²ªµ中한😀’'", "क़", "שׁ", "́", "\x1c", "\x1f", "\x85", "\xa0", "​", "\xad", "\t", "\n", "\n\n", "<|endoftext|>", "<|"]
SIGNS += ["'s", "'re", " 'll", "I'M", " ", " ", " ", "  ", "   ", ", ", ". ", "! ", " \n", "\r\n", "\r", " ", "　", "᠎", "﻿", "\x00"]


@pytest.mark.parametrize("plain", [False, True])
def test_ids_equal_the_library(plain):
    rng = random.Random(1)
    tokens, library = byte_tokens.ByteTokens(PATH, plain, cache_size=2000), Tokenizer.from_file(PATH)
    library.encode_special_tokens = plain
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(24))) for _ in range(5000)] + ["one two, three. Four\nfive " * 3000, "x" * 30_000, " " * 3000]
    for start in range(0, len(texts), 250):
        chunk = texts[start : start + 250]
        for text, ids, found in zip(chunk, tokens.encode(chunk), library.encode_batch(chunk, add_special_tokens=False)):
            assert array("I", ids).tolist() == found.ids, repr(text[:40])
            assert b"".join(tokens.token_bytes[i] for i in found.ids) == text.encode()
        ids, ends = tokens.encode_array(pa.array(chunk), 2)
        for text, a, b, found in zip(chunk, [0, *ends], ends, library.encode_batch(chunk, add_special_tokens=False)):
            assert ids[a:b].tolist() == found.ids + [2], repr(text[:40])
    assert [x.tolist() for x in tokens.encode_array(pa.array([], pa.string()), 2)] == [[], []]


def test_slices():
    texts = pa.array(["a" * 10, "b" * 25, "", "c" * 3, "d" * 100, "e"])
    found = byte_tokens.slices(texts, 20)
    assert [i for a, b in found for i in range(a, b)] == list(range(6)) and len(found) > 2 and byte_tokens.slices(texts[:0]) == []


def plain_rows(docs):
    """What the files must hold, from the library: documents in order, with the ids before each."""
    library, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    return out


def test_query_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = token_output.op12_token_files(spark, "/root/testdata/sf0.001").orderBy("start").collect()
    assert [tuple(r) for r in got] == plain_rows(docs)


def test_odd_tables(spark, tmp_path):
    rows = [(None, "null id"), (3, None), (1, ""), (2, "a b"), (2, "a b"), (2, "c"), (10**12, "word " * 100_000), (-5, "<|endoftext|> x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("file", F.lit(0)).withColumn("place", F.lit(1))
    token_files.write(df, str(tmp_path / "t"), PATH)
    got = token_files.checksums(token_files.read(spark, str(tmp_path / "t"))).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, -5, 1, 2, 2, 2, 3, 10**12]
    same = {2: sorted(((2, t) for i, t in rows if i == 2), key=lambda r: spark.range(1).select(F.xxhash64(F.lit(r[1]))).first()[0])}
    order = [(None, "null id"), (-5, "<|endoftext|> x"), (1, ""), *same[2], (3, None), (10**12, "word " * 100_000)]
    assert [tuple(r) for r in got] == plain_rows(order)
    token_files.write(df.limit(0), str(tmp_path / "e"), PATH)
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        token_files.write(df, str(tmp_path / "t"), PATH)


def test_stripes_index_and_lookup(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta"]
    df = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.element_at(F.array(*map(F.lit, words)), ((F.col("id") * 7 + i * i) % 4 + 1).cast("int"))), " ").alias("text"))
    folder = str(tmp_path / "t")
    token_files.write(df, folder, PATH, index_rows=1000, stripe_bytes=64 << 10)
    files = sorted(Path(folder).glob("*.orc"))
    metas = [orc.ORCFile(f) for f in files]
    assert all(m.row_index_stride == 1000 for m in metas) and sum(m.nstripes for m in metas) > len(files)
    ends = [(m.read(columns=["doc_id"])["doc_id"][0].as_py(), m.read(columns=["doc_id"])["doc_id"][-1].as_py()) for m in metas]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert token_files.read(spark, folder).count() == 20_000
    found = token_files.lookup(spark, folder, [4, 5, 39_998])
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan and {r["doc_id"] for r in found.collect()} == {4, 39_998}
    # a scan for an absent id inside the range reads no row group at all, by the Bloom filter
    absent = spark.read.orc(folder).where("doc_id = 20001")
    absent.collect()
    assert sum(_scan_rows(absent)) == 0
    without = str(tmp_path / "without")  # the same rows without Bloom filters: the least and greatest ids of a row group allow the id
    spark.read.orc(folder).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.option("orc.row.index.stride", 1000).orc(without)
    absent = spark.read.orc(without).where("doc_id = 20001")
    absent.collect()
    assert 0 < sum(_scan_rows(absent)) <= 1000


def _scan_rows(df):
    """Numbers of rows that the scans of an executed plan gave."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numOutputRows"):
            yield metrics.apply("numOutputRows").value()


def test_gather_takes_little_memory():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 8, 1_000)
    flat, starts, which = np.arange(sizes.sum(), dtype=np.uint32), np.cumsum(sizes) - sizes, rng.integers(0, 1_000, 500_000)
    tracemalloc.start()
    got = byte_tokens.gather(flat, starts, sizes, which)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * got.nbytes + (4 << 20)
    assert (got[: sizes[which[0]]] == flat[starts[which[0]] :][: sizes[which[0]]]).all() and len(got) == sizes[which].sum()
    assert (byte_tokens.gather(flat, starts, sizes, together=7) == flat).all() and not len(byte_tokens.gather(flat, starts[:0], sizes[:0]))
