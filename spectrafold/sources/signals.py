"""Signals from tables: aggregation to a grid, dictionaries of axis labels, missing cells, and back again.

A fact table of any size is aggregated first (partial sums before the shuffle), and only the grid of
cells, whose size is the product of the axes, is completed. A cell that no row falls into is NULL, which is
how missing observations are told; NaN is turned into NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def require_double(df: DataFrame, *columns: str) -> None:
    """Raise TypeError unless the columns are doubles or arrays of doubles."""
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        if kind not in ("double", "array<double>"):
            raise TypeError(f"column {c} is {kind}, not double")


def axis(df: DataFrame, label: str, number: str = "ax") -> DataFrame:
    """number, label: the distinct labels in order, numbered from 0.

    The labels of an axis are numbered in one task: they are as many as the axis is long, after the
    distinct, which runs spread out. ``large_axis`` takes several, for axes of millions.
    """
    distinct = df.select(F.col(label).alias("label")).where("label is not null").distinct()
    return distinct.select((F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias(number), "label")


def large_axis(df: DataFrame, label: str, number: str = "ax") -> DataFrame:
    """The same for axes of any length: labels are sorted by ranges, and no task numbers more than one range.

    The ranges are written to the checkpoint folder, since other ones would be drawn if they were made again.
    """
    distinct = df.select(F.col(label).alias("label")).where("label is not null").distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(distinct.repartitionByRange(parts, "label").select("label", F.spark_partition_id().alias("_range")))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.expr("sum(_n) OVER (ORDER BY _range) - _n").alias("_before"))  # one row for each range
    place = F.row_number().over(Window.partitionBy("_range").orderBy("label")) - 1
    numbered = ranged.withColumn("_place", place).join(F.broadcast(before), "_range")
    return numbered.select((F.col("_before") + F.col("_place")).cast("int").alias(number), "label")


def cube(df: DataFrame, labels: Sequence[str], value: Column, fill: float | None = None, large: Sequence[str] = ()) -> tuple[DataFrame, list[DataFrame]]:
    """A signal (ax0, ax1, ..., v) of an aggregate of a table over label columns, and the axis dictionaries.

    Every combination of labels is a cell; cells without rows have ``fill``. ``large``: the labels with millions of values.
    """
    cells = df.groupBy(*labels).agg(value.cast("double").alias("v"))
    dictionaries = [(large_axis if name in large else axis)(cells, name, f"ax{a}") for a, name in enumerate(labels)]
    grid = reduce(lambda one, other: one.join(other, how="cross"), [d.withColumnRenamed("label", name) for d, name in zip(dictionaries, labels)])
    full = grid.join(cells, list(labels), "left")
    return full.select(*[f"ax{a}" for a in range(len(labels))], nan_to_null(F.coalesce("v", F.lit(fill)) if fill is not None else F.col("v")).alias("v")), dictionaries


def nan_to_null(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def with_labels(signal: DataFrame, dictionaries: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """A signal with its labels in place of the coordinates."""
    for a, (d, name) in enumerate(zip(dictionaries, names)):
        signal = signal.join(d.withColumnRenamed("label", name), f"ax{a}").drop(f"ax{a}")
    return signal.select(*names, *[c for c in signal.columns if c not in names])


def from_pandas(spark: SparkSession, frame: pd.DataFrame) -> tuple[DataFrame, list[list]]:
    """A two-axis signal of a frame, and the labels of its index and columns."""
    rows = [(i, j, None if pd.isna(v) else float(v)) for i, row in enumerate(frame.to_numpy()) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "ax0 int, ax1 int, v double"), [frame.index.tolist(), frame.columns.tolist()]


def to_pandas(signal: DataFrame, labels: Sequence[Sequence], value: str = "v") -> pd.DataFrame:
    """The frame of a two-axis signal, with the labels of its index and columns."""
    table = signal.select("ax0", "ax1", value).toPandas().pivot(index="ax0", columns="ax1", values=value)
    table = table.reindex(index=range(len(labels[0])), columns=range(len(labels[1])))
    return table.set_axis(list(labels[0]), axis=0).set_axis(list(labels[1]), axis=1)


def statistics(signal: DataFrame, by: Sequence[str] = (), value: str = "v") -> DataFrame:
    """loc and scale (population standard deviation, 1 if it is 0) of the observed values of each group."""
    loc, scale = F.avg(value).alias("loc"), F.stddev_pop(value)
    fine = F.when(scale > 0, scale).otherwise(1.0).alias("scale")
    return signal.groupBy(*by).agg(loc, fine) if by else signal.agg(loc, fine)


def preprocess(signal: DataFrame, by: Sequence[str] = (), value: str = "v") -> DataFrame:
    """The signal with ``obs``, whether the value is there, and values normalised, 0 where missing."""
    s = statistics(signal, by, value)
    both = signal.join(s, list(by)) if by else signal.join(F.broadcast(s), how="cross")  # one row
    normal = (F.col(value) - F.col("loc")) / F.col("scale")
    return both.withColumn("obs", F.col(value).isNotNull()).withColumn(value, F.coalesce(normal, F.lit(0.0)))


def postprocess(signal: DataFrame, value: str = "v") -> DataFrame:
    """Values back in their own units; ``loc`` and ``scale`` go."""
    return signal.withColumn(value, F.col(value) * F.col("scale") + F.col("loc")).drop("loc", "scale")
