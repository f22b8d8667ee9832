"""Plans for graphs of any size, constructors, and coordinates that a graph doesn't have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.catalog import _Network
from spectrafold.functions.filters import multivariate, univariate
from spectrafold.operators import dense, distributed, transform
from spectrafold.operators.graphs import DENSE_NODES, Graph, ProductGraph
from spectrafold.operators.models import GSR, RNC
from spectrafold.plans import rules
from spectrafold.sources import signals


def test_a_long_chain_is_filtered_without_arrays(spark, monkeypatch):
    monkeypatch.setattr(Graph, "_dense", property(lambda self: pytest.fail("a decomposition")))
    n = 100_000
    graph, y = Graph.chain(spark, n), spark.range(n).select(F.col("id").cast("int").alias("ax0"), (F.col("id") % 7).cast("double").alias("v"))
    got = np.array([r["v"] for r in transform.filter_signal(y, graph, univariate("diffusion", 0.4)).orderBy("ax0").collect()])
    # a kernel of a few nodes: exp(-0.4 L) of a short chain, in its middle
    k = np.arange(41)
    u = np.sqrt(np.where(k > 0, 2.0, 1.0) / 41) * np.cos(np.pi * (k[:, None] + 0.5) * k / 41)
    kernel = ((u * np.exp(-0.4 * (2 - 2 * np.cos(np.pi * k / 41)))) @ u.T)[20]
    want = np.convolve(np.arange(n) % 7, kernel, "same")
    assert np.abs(got - want)[25:-25].max() < 1e-6
    assert rules.choose(graph, False) == "tables" and rules.choose(Graph.chain(spark, 50), False) == "task"


def test_models_refuse_axes_that_have_no_arrays(spark):
    y = spark.createDataFrame([(0, 1.0)], "ax0 int, v double")
    with pytest.raises(ValueError, match="an axis of more than"):
        GSR(y, Graph.chain(spark, DENSE_NODES + 1), univariate("diffusion", 1.0), 0.5)
    with pytest.raises(ValueError, match="isn't decomposed"):
        Graph.complete(spark, DENSE_NODES + 1).u
    with pytest.raises(TypeError, match="not double"):
        GSR(spark.createDataFrame([(0, 1)], "ax0 int, v int"), Graph.chain(spark, 3), univariate("diffusion", 1.0), 0.5)


@pytest.mark.parametrize("g", [univariate("diffusion", 0.4), multivariate("random_walk", 0.4, 0.2)])
def test_table_solver_equals_arrays(spark, g):
    graph, rng = ProductGraph(Graph.chain(spark, 6), Graph.loop(spark, 5)), np.random.default_rng(1)
    y, s = rng.standard_normal((6, 5)), rng.random((6, 5)) < 0.6
    rows = [(i, j, float(y[i, j]) if s[i, j] else None) for i in range(6) for j in range(5)]
    got = distributed.reconstruct(spark.createDataFrame(rows, "ax0 int, ax1 int, v double"), graph, g, 0.5)
    prior = dense.Prior(tuple(f.u for f in graph.factors), transform.gain_array(graph, g))
    want = dense.gsr(y * s, s.astype(float), prior, 0.5)
    assert all(abs(r["v"] - want[r["ax0"], r["ax1"]]) < 1e-6 for r in got.collect()) and got.count() == 30


@pytest.mark.parametrize("make", [lambda s: Graph.chain(s, 7), lambda s: Graph.loop(s, 7), lambda s: Graph.loop(s, 8), lambda s: Graph.complete(s, 6), lambda s: Graph.chain(s, 1), lambda s: Graph.random_connected(s, 9)])
def test_axis_kernels(spark, make):
    graph = make(spark)
    lap = np.zeros((graph.n, graph.n))
    for r in graph.laplacian().collect():
        lap[r["i"], r["j"]] = r["w"]
    lam, u = np.linalg.eigh(lap)
    want = (u * np.exp(-0.3 * lam)) @ u.T
    got = np.zeros_like(want)
    for r in transform.axis_kernel(graph, F.exp(-0.3 * F.col("lam"))).collect():
        got[r["i"], r["j"]] += r["u"]
    assert np.abs(got - want).max() < 1e-9


def test_polynomials_on_products(spark):
    graph, rng = ProductGraph(Graph.random_connected(spark, 6), Graph.complete(spark, 4)), np.random.default_rng(2)
    rows = [(i, j, c, float(rng.standard_normal())) for i in range(6) for j in range(4) for c in range(2)]
    y = spark.createDataFrame(rows, "ax0 int, ax1 int, c int, v double")
    one = transform.chebyshev(y, graph, univariate("diffusion", 0.3), degree=18, power=2.0).collect()
    other = {(r["ax0"], r["ax1"], r["c"]): r["v"] for r in transform.filter_signal(y, graph, univariate("diffusion", 0.6)).collect()}
    assert len(one) == 48 and all(abs(r["v"] - other[r["ax0"], r["ax1"], r["c"]]) < 1e-6 for r in one)


def test_coordinates_outside_of_the_graph_fail(spark):
    y = spark.createDataFrame([(0, 1.0), (30, 1.0)], "ax0 int, v double")
    for f in (lambda: transform.gft(y, Graph.chain(spark, 30)), lambda: transform.filter_signal(y, Graph.chain(spark, 30), univariate("diffusion", 0.1))):
        with pytest.raises(Exception, match="outside of the 30 nodes"):
            f().collect()


def test_constructors_refuse_what_they_cannot_make(spark):
    with pytest.raises(ValueError):
        Graph.of(spark)
    with pytest.raises(ValueError):
        Graph.of(spark, adjacency=np.eye(2), laplacian=np.eye(2))
    with pytest.raises(ValueError):
        Graph.from_networkx([1, 2], spark)
    with pytest.raises(ValueError):
        ProductGraph.of((2, 2))
    ring = np.zeros((6, 6))
    for i in range(6):
        ring[i, (i + 1) % 6] = ring[(i + 1) % 6, i] = 1
    with pytest.raises(ValueError, match="isn't a Kronecker sum"):
        ProductGraph.of((2, 3), spark, adjacency=ring)
    named = _Network(["x", "y", "z"], [("x", "y", 2.0), ("y", "z", 3.0)])
    assert {(r["node"], r["degree"]) for r in Graph.from_networkx(named, spark).degrees().collect()} == {(0, 2.0), (1, 5.0), (2, 3.0)}
    assert repr(ProductGraph.from_networkx(named, named, spark=spark)) == "ProductGraph(3 x 3)"


def test_draws_and_fits_of_many_problems(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, float(rng.standard_normal()) if i % 3 else None, [1.0, i / 5]) for k in range(2) for i in range(5)]
    y = spark.createDataFrame(rows, "k int, ax0 int, v double, x array<double>")
    model = RNC(y, Graph.chain(spark, 5), univariate("diffusion", 0.5), 0.5, by=("k",), lam=1.0)
    draws = list(model.generate_samples(2, seed=1))
    assert [d.count() for d in draws] == [10, 10] and draws[0].columns == ["sample", "k", "ax0", "v"]
    assert {tuple(r) for r in draws[0].collect()} == {tuple(r) for r in model.sample(1, 1).collect()}
    fitted = model.fit()
    f = {(r["k"], r["ax0"]): r["f"] for r in fitted.predictor(y).collect()}
    assert all(abs(f[r["k"], r["ax0"]] - r["v"]) < 1e-9 + abs(f[r["k"], r["ax0"]]) * 10 for r in fitted.cells.collect()) and len(f) == 10
    bad = spark.createDataFrame([(0, i, 1.0, [1.0, None]) for i in range(5)], "k int, ax0 int, v double, x array<double>")
    with pytest.raises(Exception, match="features without nulls"):
        RNC(bad, Graph.chain(spark, 5), univariate("diffusion", 0.5), 0.5, by=("k",), lam=1.0).sample(1).collect()


def test_frames(spark):
    import pandas as pd

    frame = pd.DataFrame([[1.0, None], [3.0, 4.0]], index=["a", "b"], columns=["x", "y"])
    signal, labels = signals.from_pandas(spark, frame)
    assert signals.to_pandas(signal, labels).equals(frame)


@pytest.mark.parametrize("name", ["random_walk", "diffusion", "relu", "sigmoid", "bandlimited"])
@pytest.mark.parametrize(("beta", "top"), [(0.4, 4.0), (10.0, 4.0), (0.4, 20_001.0), (0.01, 50.0)])
def test_polynomial_gains_are_right_or_refused(name, beta, top):
    g, x = univariate(name, beta), np.linspace(0, top, 20_001)
    try:
        c = transform.chebyshev_coefficients(lambda lam: g.array(lam), top)
    except ValueError as e:
        assert "doesn't come within" in str(e) and (name in ("relu", "bandlimited") or top > 1000)
        return
    assert np.abs(np.polynomial.chebyshev.chebval(2 * x / top - 1, [c[0] / 2, *c[1:]]) - g.array(x)).max() <= transform.GAIN_ERROR
    assert len(c) <= transform.MAX_DEGREE + 1


def test_long_axes_refuse_steps_and_have_small_errors(spark):
    n = transform.SPECTRAL_NODES + 1
    graph = Graph.loop(spark, n)
    y = spark.range(n).select(F.col("id").cast("int").alias("ax0"), F.cos(2 * np.pi * 100 * F.col("id") / n).alias("v"))  # an eigenvector
    lam = 2 - 2 * np.cos(2 * np.pi * 100 / n)
    got = transform.filter_signal(y, graph, univariate("random_walk", 50.0)).join(y.withColumnRenamed("v", "w"), "ax0")
    assert got.agg(F.max(F.abs(F.col("v") - F.col("w") / (1 + 50 * lam)))).first()[0] < 1e-5
    with pytest.raises(ValueError, match="doesn't come within"):
        transform.filter_signal(y, graph, univariate("bandlimited", 1.0))
    assert transform.largest_frequency(ProductGraph(Graph.complete(spark, 7), Graph.chain(spark, 3))) == 11


def test_irregular_graphs_beyond_a_decomposition_are_filtered_by_their_edges(spark, monkeypatch):
    rng, n = np.random.default_rng(8), 60
    pairs = {tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(150)}
    graph = Graph.from_edges(spark.createDataFrame(sorted(pairs), "src int, dst int"), n)
    lap = np.zeros((n, n))
    for a, b in pairs:
        lap[a, b] = lap[b, a] = -1
    lap -= np.diag(lap.sum(1))
    v = rng.standard_normal(n)
    y = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "ax0 int, v double")
    monkeypatch.setattr(transform, "DENSE_NODES", 50)
    monkeypatch.setattr(Graph, "_dense", property(lambda self: pytest.fail("a decomposition")))
    lam, u = np.linalg.eigh(lap)
    for g in (univariate("diffusion", 0.2), univariate("random_walk", 0.3)):
        got = np.array([r["v"] for r in transform.filter_signal(y, graph, g).orderBy("ax0").collect()])
        assert np.abs(got - u @ (g.array(lam) * (u.T @ v))).max() < 1e-6


def test_large_axes_are_numbered_by_ranges(spark):
    df = spark.range(30_000).select(F.format_string("k%06d", F.pmod(F.col("id") * 7919, F.lit(20_011))).alias("label")).union(spark.createDataFrame([(None,)], "label string"))
    want = {r["label"]: r["ax0"] for r in signals.axis(df, "label", "ax0").collect()}
    got = {r["label"]: r["ax0"] for r in signals.large_axis(df, "label", "ax0").collect()}
    assert got == want and len(got) == 20_011
    rows = spark.createDataFrame([("b", "x", 1.0), ("a", "y", 2.0)], "one string, two string, v double")
    both = [{tuple(r) for r in signals.cube(rows, ["one", "two"], F.sum("v"), large=large)[0].collect()} for large in ((), ("one",))]
    assert both[0] == both[1] and len(both[0]) == 4
