"""Keeping a filtered signal fresh from a stream of rows.

Rows are counted by event-time window and category with a watermark: rows up to ``delay`` late still count,
later ones don't, and the stream's state of closed windows goes. Each micro-batch gives the counts that
changed; they are merged into a table of all windows so far beside the stream's checkpoint, one version for
each batch, so that a batch that runs again writes the same version; the version before the last, which no batch needs
any more, is deleted. The table has the size of the grid, not of the stream; the grid is then filtered anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.filters import Filter
from ..operators.graphs import ProductGraph, grid, inside
from ..operators.transform import filter_signal
from ..plans.lineage import remove
from ..sources.signals import axis


def windowed_counts(rows: DataFrame, time: str, category: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """start, category, n of a streaming (or static) table."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need a time zone
    timed = timed.withWatermark(time, delay) if rows.isStreaming else timed
    return timed.groupBy(F.window(time, window).alias("w"), F.col(category).alias("category")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "category", "n")


def to_signal(counts: DataFrame, graph: ProductGraph) -> DataFrame:
    """The last windows by categories as a signal on the graph; windows and categories without rows are 0."""
    n0 = graph.shape[0]
    starts = counts.select("start").distinct().orderBy(F.desc("start")).limit(n0)
    kept = counts.join(starts, "start")
    cells = kept.join(axis(kept, "start", "ax0").withColumnRenamed("label", "start"), "start").join(axis(counts, "category", "ax1").withColumnRenamed("label", "category"), "category")
    cells = inside(cells.select("ax0", "ax1", F.col("n").cast("double").alias("v")), graph)  # a category too many fails
    return grid(graph).join(cells, ["ax0", "ax1"], "left").fillna(0.0, ["v"])


def refresh(rows: DataFrame, time: str, category: str, graph: ProductGraph, g: Filter, sink: Callable[[DataFrame, int], None], checkpoint: str, window: str = "1 day", delay: str = "1 hour") -> StreamingQuery:
    """Start a query that hands the filtered signal of all counts so far to ``sink`` after each micro-batch.

    ``checkpoint`` is a folder in a store that all executors reach.
    """
    version = lambda number: f"{checkpoint}/counts/{number}"

    def batch(changed: DataFrame, number: int) -> None:
        changed = changed.select("start", "category", "n")
        if number:
            before = changed.sparkSession.read.parquet(version(number - 1))
            # null-safe: rows without a category are one category
            same = (F.col("old.start") == F.col("new.start")) & F.col("old.category").eqNullSafe(F.col("new.category"))
            changed = before.alias("old").join(changed.alias("new"), same, "left_anti").unionByName(changed)
        changed.write.mode("overwrite").parquet(version(number))
        counts = changed.sparkSession.read.parquet(version(number))
        sink(filter_signal(to_signal(counts, graph), graph, g), number)
        if number > 1:
            remove(changed.sparkSession, version(number - 2))

    counts = windowed_counts(rows, time, category, window, delay)
    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch).start()
