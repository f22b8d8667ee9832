"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut, free, scratch

__all__ = ["beside", "crc32_of_id", "cut", "free", "fresh", "from_driver", "let", "portions", "row_hash", "scratch", "shuffle_partitions", "spread_join", "table", "texts", "unit_hash"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside(df: DataFrame, *replaced: str) -> Column:
    """All columns of ``df`` but those replaced, as one struct ``row``, so that no name of theirs meets an own one."""
    names = {r.lower() for r in replaced}
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names]).alias("row")


def texts(df: DataFrame, text: str, *replaced: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """``df`` as one struct ``row`` (see ``beside``), and what finds the texts in a batch of it.

    Whole texts are most of what is sent to a worker and kept there: one that is in ``row`` isn't sent beside it.
    """
    row = df.select(beside(df, *replaced))
    at = [i for i, f in enumerate(row.schema["row"].dataType.fields) if f.name == text and "." not in text]
    if at:
        return row, lambda batch: batch.column("row").field(at[0])
    return df.select(beside(df, *replaced), F.col(text).alias("text")), lambda batch: batch.column("text")


def portions(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that few texts are there as Python strings at once."""
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            yield whole.slice(start, rows)


def from_driver(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few rows as a table, sent as Arrow: tuples would become an RDD, for which executors start Python workers of another kind."""
    columns = list(zip(*rows)) or [()] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c) for c in columns], names=schema.names), schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have: ``name``, with underscores as needed."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash of all columns of a row that can be hashed (maps can't)."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once for each row, also where a lambda uses it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc32_of_id(col: str = "doc_id") -> Column:
    """crc32 of the decimal form of an id, by which folds are drawn."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def unit_hash(*cols: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns only; the same on every run and machine."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / float(1 << 40)


def spread_join(big: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has one row for each key, where any share of ``big`` may have one key.

    The rows of a key are dealt by ``by`` over as many salts as there are shuffle partitions; each salt that a
    key really has gets a copy of its row of ``small``. Meant for tables of this package (a column ``_salt``).
    """
    salts = shuffle_partitions(big.sparkSession)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(F.lit(11), by), F.lit(salts)).cast("int"))
    copies = salted.select(*on, "_salt").distinct().join(small, on)
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
