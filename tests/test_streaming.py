"""A streamed signal equals the batch one."""

import datetime

import pytest

from spectrafold.functions.filters import univariate
from spectrafold.operators.graphs import Graph, ProductGraph
from spectrafold.operators.transform import filter_signal
from spectrafold.streaming import refresh

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_refresh(spark, tmp_path):
    graph, g = ProductGraph(Graph.chain(spark, 30), Graph.complete(spark, 5)), univariate("diffusion", 0.4)
    static = spark.read.parquet(EVENTS)
    folder = str(tmp_path / "in")
    static.repartition(2).write.parquet(folder)
    stream = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    seen = []
    query = refresh.refresh(stream, "ts", "event_type", graph, g, lambda df, n: seen.append(df.collect()), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    batch = filter_signal(refresh.to_signal(refresh.windowed_counts(static, "ts", "event_type"), graph), graph, g).collect()
    key = lambda rows: sorted((r["ax0"], r["ax1"], round(r["v"], 6)) for r in rows)
    assert len(seen) >= 2 and key(seen[-1]) == key(batch)


def test_late_rows_and_categories(spark, tmp_path):
    """Rows within the delay still count, later ones don't, and a category too many fails."""
    graph, g = ProductGraph(Graph.chain(spark, 3), Graph.complete(spark, 2)), univariate("diffusion", 0.0)
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour)
    batches = [[(at(1, 5), "a"), (at(2, 0), "b")], [(at(3, 2), "a")], [(at(3, 1), "b")], [(at(1, 6), "a")], [(at(3, 3), "a")]]
    folder, seen = tmp_path / "in", []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.parquet(str(folder / str(i)))
    stream = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    query = refresh.refresh(stream, "ts", "kind", graph, g, lambda df, n: seen.append({(r["ax0"], r["ax1"]): round(r["v"], 6) for r in df.collect()}), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    want = {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 1, (2, 0): 2, (2, 1): 1}
    assert len(list((tmp_path / "state" / "counts").glob("*/_SUCCESS"))) == 2
    assert seen[-1] == want, seen  # the row of day 1 that came when day 1 was closed isn't counted
    counts = spark.createDataFrame([(at(1, 0), k, 1) for k in "abc"], "start timestamp, category string, n long")
    with pytest.raises(Exception, match="outside of the 2 nodes"):
        refresh.to_signal(counts, graph).collect()
