"""Link functions and class encodings as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def logistic(f: Column) -> Column:
    """1 / (1 + exp(-f))."""
    return 1 / (1 + F.exp(-f))


def softmax(f: Column) -> Column:
    """Softmax of an array of class values, shifted by their maximum so that it can't overflow."""
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  evaluated once for each row
    powers = once(F.array_max(f), lambda top: F.transform(f, lambda x: F.exp(x - top)))
    return once(powers, lambda p: once(F.aggregate(p, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(p, lambda x: x / total)))


def softmax_over(value: Column, cell: Sequence[str]) -> Column:
    """Softmax over the rows of one cell, one row for each class."""
    w = Window.partitionBy(*cell)
    shifted = F.exp(value - F.max(value).over(w))
    return shifted / F.sum(shifted).over(w)


def threshold(f: Column) -> Column:
    """1 where f is over 0, else 0."""
    return (f > 0).cast("int")


def argmax(df: DataFrame, cell: Sequence[str], label: str, value: str) -> DataFrame:
    """For each cell the label of the greatest value, the smallest of equals (an aggregate with partial sums)."""
    best = F.max(F.struct(F.col(value), (-F.col(label)).alias("_n")))
    return df.groupBy(*cell).agg((-best["_n"]).alias(label))


def argmax_array(f: Column) -> Column:
    """The position, from 0, of the first greatest value of an array."""
    return (F.array_position(f, F.array_max(f)) - 1).cast("int")


def one_hot(df: DataFrame, label: str, classes: int, out: str = "v") -> DataFrame:
    """A row for each class of each row, with 1.0 for its label and 0.0 else; null labels give null values.

    Labels outside 0 .. classes - 1 fail the query.
    """
    bad = F.raise_error(F.concat(F.lit("label out of range: "), F.col(label).cast("string")))
    checked = F.when(F.col(label).isNull() | F.col(label).between(0, classes - 1), F.col(label)).otherwise(bad.cast("int"))
    return df.withColumn("_label", checked).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))).withColumn(out, (F.col("c") == F.col("_label")).cast("double")).drop("_label")


def one_hot_array(label: Column, classes: int) -> Column:
    """The one-hot code of a label as an array of doubles."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == label).cast("double"))
