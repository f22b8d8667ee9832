"""Token ids of documents as ORC files: runs of integers, row indexes, Bloom filters on the ids of documents.

Documents are dealt by ranges of their ids, sorted within a range, encoded and written, one file a range, so
that the files in the order of their names hold all documents in ascending order. A row has the document's
id, its token ids as an array of integers, their number, the number of the file and how many token ids of the
file come before it. Integers are written as ORC's runs (delta, repeated and packed). Every ``index_rows`` rows
have an entry in the row index and a Bloom filter of the ids, so that a lookup reads the footers and the few row
groups that can have its documents. Stripes are read in parallel, since no row needs the one before it: where
a document starts in the whole is the sum of the files before, a few numbers, and its place in its own file.

Null ids come first, documents of one id in the order of their texts' hashes; equal rows are written each. Null
texts count as empty: the end id alone. An empty table gives a folder without rows. Texts may be of any length.
Columns other than id and text are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_tokens import ByteTokens, slices
from .common import shuffle_partitions

_TOKENS: dict[str, ByteTokens] = {}


def write(
    df: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    index_rows: int = 1000,
    stripe_bytes: int = 64 << 20,
    false_positives: float = 0.01,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode all documents and write them to the folder ``path``, which Spark's readers and writers can reach."""
    schema = T.StructType([
        T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("file", T.IntegerType()), T.StructField("place", T.LongType()),
        T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _TOKENS:
            _TOKENS[tokenizer_path] = ByteTokens(tokenizer_path)
        tokens = _TOKENS[tokenizer_path]
        file, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            docs, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            for a, b in slices(texts):  # so that the ids of long texts don't add up
                ids, ends = tokens.encode_array(texts.slice(a, b - a), end_id)
                starts = np.append(0, ends)
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.view(np.int32)))
                numbers = [np.full(b - a, file, "i4"), place + starts[:-1], np.diff(starts).astype("i4")]
                yield pa.RecordBatch.from_arrays([docs.slice(a, b - a), *map(pa.array, numbers), lists], names=schema.names)
                place += int(starts[-1])

    read = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    parts = max(shuffle_partitions(df.sparkSession), read.rdd.getNumPartitions())
    ranged = read.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    options = {
        "orc.create.index": "true", "orc.row.index.stride": index_rows, "orc.stripe.size": stripe_bytes, "orc.rows.between.memory.checks": min(index_rows, 1000),
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": false_positives, "compression": "zstd",
    }
    ranged.mapInArrow(run, schema).write.mode("errorifexists").options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document of a folder; ``start``: the token ids of all documents before it."""
    rows = spark.read.orc(path)
    sizes = rows.groupBy("file").agg(F.sum(F.col("n_tokens").cast("long")).alias("size"))  # one row for each file
    before = sizes.select("file", F.expr("sum(size) OVER (ORDER BY file) - size").alias("before"))
    return rows.join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.col("place")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """doc_id and ids of the documents of the given ids, from the row groups whose index and Bloom filter allow them."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def checksums(df: DataFrame) -> DataFrame:
    """``df`` with ``ids_crc32``, the crc32 of the ids as little-endian unsigned 32-bit integers, in place of ``ids``."""
    kept = [f for f in df.schema.fields if f.name != "ids"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sums, pa.int64())], names=[*names, "ids_crc32"])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField("ids_crc32", T.LongType())]))
