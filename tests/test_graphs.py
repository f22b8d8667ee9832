"""Graphs, spectra and transforms against dense algebra."""

import numpy as np
import pytest

from spectrafold.functions.filters import univariate
from spectrafold.operators import transform
from spectrafold.operators.graphs import Graph, ProductGraph


def dense_laplacian(g):
    out = np.zeros((g.n, g.n))
    for i, j, w in g.laplacian().collect():
        out[i, j] = w
    return out


@pytest.mark.parametrize("make", [lambda s: Graph.chain(s, 7), lambda s: Graph.loop(s, 6), lambda s: Graph.loop(s, 7), lambda s: Graph.loop(s, 2), lambda s: Graph.complete(s, 5), lambda s: Graph.random_tree(s, 8)])
def test_basis_tables_diagonalise(spark, make):
    g = make(spark)
    u, lam = np.zeros((g.n, g.n)), np.zeros(g.n)
    for i, k, v in g.basis().collect():
        u[i, k] = v
    for k, v in g.spectrum().collect():
        lam[k] = v
    assert np.allclose(u.T @ u, np.eye(g.n), atol=1e-9)
    assert np.allclose(u @ np.diag(lam) @ u.T, dense_laplacian(g), atol=1e-9)
    assert np.allclose(g.u @ np.diag(g.lam) @ g.u.T, dense_laplacian(g), atol=1e-9)


def test_round_trip_on_a_product(spark):
    g = ProductGraph.torus(spark, 4, 5)
    y = np.random.default_rng(0).standard_normal((4, 5))
    t = spark.createDataFrame([(i, j, float(y[i, j])) for i in range(4) for j in range(5)], "ax0 int, ax1 int, v double")
    back = np.zeros((4, 5))
    for i, j, v in transform.rgft(transform.gft(t, g), g).collect():
        back[i, j] = v
    assert np.allclose(back, y)
    assert transform.laplacian_product(t, g).count() == 20


def test_errors(spark):
    with pytest.raises(ValueError):
        Graph.loop(spark, 1)
    with pytest.raises(ValueError):
        Graph.random_regular(spark, 5, 2)
    with pytest.raises(ValueError):
        Graph.from_adjacency(np.array([[0.0, 1], [0, 0]]), spark=spark)
    with pytest.raises(ValueError):
        Graph.from_adjacency(np.array([[1.0, 1], [1, 0]]), spark=spark)
    with pytest.raises(ValueError):
        Graph.from_laplacian(np.array([[2.0, -1], [-1, 1]]), spark=spark)
    with pytest.raises(ValueError):
        ProductGraph(Graph.chain(spark, 3))
    with pytest.raises(ValueError):
        univariate("diffusion", -1)
