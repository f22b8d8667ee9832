"""Removal of repeated lines by overlapping windows of three consecutive lines.

Every window of three lines is hashed (128 bits). Of each window that occurs more than once anywhere, the
first occurrence, by document id and line number, stays; the lines that later occurrences cover are merged
per document and removed. Every line that goes is still there in an earlier place.

Only hashes are shuffled to find repeats: one row for each window. A window that very many documents have
is counted before the shuffle, and meets its occurrences in a join that Spark can split.

Defined results: null texts stay null and have no lines; documents of fewer than three lines keep all of
them; blank lines count as lines; equal rows (same id, same text) are one document, and each of them gets
that document's result; rows with the same id and other texts are ordered by a hash of the text; null ids
come first. A text that loses all lines becomes empty. Texts may have any number of lines of any length; an
empty table gives an empty one. All columns are kept, whatever their names, ``text`` changed; ``n_lines``
and ``n_removed`` are added, and replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, let


def _windows(lines: Column, width: int) -> Column:
    """An array of (pos, a, b): the two hashes of the window that begins at each line but the last."""
    hashed = F.struct(F.transform(lines, lambda x: F.xxhash64(x)).alias("one"), F.transform(lines, lambda x: F.xxhash64(F.lit(1), x)).alias("two"))

    def of(h: Column) -> Column:
        pick = lambda hashes, i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)])
        starts = F.sequence(F.lit(0), F.size(h["one"]) - width)
        return F.transform(starts, lambda i: F.struct(i.alias("pos"), pick(h["one"], i).alias("a"), pick(h["two"], i).alias("b")))

    return let(hashed, of)


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``df`` without the lines that later occurrences of repeated windows cover."""
    keys = {"k": F.xxhash64("d", "t"), "l": F.xxhash64(F.lit(1), "d", "t")}  # of a document, in 128 bits
    rows = df.select(beside(df, "n_lines", "n_removed"), F.col(doc_id).alias("d"), F.col(text).alias("t")).withColumns(keys)
    lines = F.split("t", "\n")
    found = (
        rows.select("d", "k", "l", lines.alias("lines"))
        .where(F.size("lines") >= width)
        .select("d", "k", "l", F.explode(_windows(F.col("lines"), width)).alias("w"))
        .select("d", "k", "l", "w.*")
    )
    place = F.struct("d", "k", "l", "pos")
    first = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(first, ["a", "b"]).where(place > F.col("first"))
    covered = later.groupBy("k", "l").agg(F.collect_set("pos").alias("starts"))
    gone = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (width - 1))))
    left = let(lines, lambda x: let(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda k: F.struct(F.array_join(F.transform(k, lambda i: F.get(x, i)), "\n").alias("text"), F.size(k).alias("n"))))
    out = rows.join(covered, ["k", "l"], "left").withColumn("left", F.when(F.col("starts").isNotNull(), left))
    n_lines = F.when(F.col("t").isNull(), 0).otherwise(F.size(lines))
    names = [c for c in df.columns if c.lower() not in ("n_lines", "n_removed")]
    changed = F.when(F.col("left").isNull(), F.col("t")).otherwise(F.col("left.text"))
    return out.select(
        *[(changed if c == text else F.col("row").getField(c)).alias(c) for c in names],
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("left").isNull(), 0).otherwise(n_lines - F.col("left.n")).cast("long").alias("n_removed"),
    )
