"""Random graphs beyond the nodes that numpy takes: spanning trees and components over tables."""

import numpy as np
import pytest

from spectrafold import catalog
from spectrafold.operators import forests, graphs
from spectrafold.operators.graphs import Graph

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("close", [1.0, 0.02])
def test_spanning_tree_over_tables_is_that_of_prim(spark, close):
    """Also where parts lie apart, so that the radius must grow; links left for the driver: few."""
    points = np.random.default_rng(5).random((150, 2))
    points[:60] *= close
    table = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "node int, x double, y double")
    assert {tuple(r) for r in forests.spanning_tree(table, small=30).collect()} == graphs.spanning_tree(points)


def test_components_are_counted_over_tables(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(3, 1), (1, 3), (50, 50)], "src int, dst int")
    assert forests.components(edges, 60, small=4) == 60 - 36


def test_random_graphs_beyond_arrays(spark, monkeypatch):
    monkeypatch.setattr(graphs, "DENSE_NODES", 5)
    regular = Graph.random_regular(spark, 12, 3, 1)
    assert [tuple(r) for r in regular.edges.groupBy("src").count().groupBy("count").count().collect()] == [(3, 12)]
    assert regular.edges.distinct().count() == 36
    rows = {(r.graph, r.measure): r.value for r in catalog.graph_random_invariants(spark, SF_DIR).collect()}
    assert rows == {
        ("tree", "nodes"): 10, ("tree", "edges"): 9, ("tree", "components"): 1, ("connected", "nodes"): 10, ("connected", "components"): 1,
        ("regular", "nodes"): 10, ("regular", "edges"): 15, ("regular", "least degree"): 3, ("regular", "greatest degree"): 3,
    }


def test_products_of_random_graphs_beyond_arrays(spark, monkeypatch):
    monkeypatch.setattr(graphs, "DENSE_NODES", 5)
    assert [tuple(r) for r in catalog.product_random_connected(spark, SF_DIR).orderBy("axis").collect()] == [(0, 10, 1), (1, 25, 1)]
