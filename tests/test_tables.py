"""Models over tables against the array solvers: means, labels, weights, kernels, draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.functions.filters import custom, multivariate, univariate
from spectrafold.operators import dense, tables, transform
from spectrafold.operators.graphs import Graph, ProductGraph
from spectrafold.operators.tables import TableModel

SHAPE, GAMMA = (6, 5), 0.7


@pytest.fixture(scope="module")
def graph(spark):
    return ProductGraph(Graph.chain(spark, SHAPE[0]), Graph.loop(spark, SHAPE[1]))


def problem(spark, seed, labels=0):
    """A table (ax0, ax1, v, x) with missing cells, and its arrays."""
    rng = np.random.default_rng(seed)
    y, s, x = rng.standard_normal(SHAPE), rng.random(SHAPE) < 0.7, rng.standard_normal((*SHAPE, 2))
    if labels:
        y = rng.integers(0, labels, SHAPE).astype(float)
    rows = [(i, j, float(y[i, j]) if s[i, j] else None, x[i, j].tolist()) for i in range(SHAPE[0]) for j in range(SHAPE[1])]
    return spark.createDataFrame(rows, "ax0 int, ax1 int, v double, x array<double>"), y * s, s.astype(float), x


def prior_of(graph, g):
    return dense.Prior(tuple(f.u for f in graph.factors), transform.gain_array(graph, g))


def grid_of(df, column="v"):
    out = np.full(SHAPE, np.nan)
    for r in df.collect():
        out[r["ax0"], r["ax1"]] = r[column]
    return out


@pytest.mark.parametrize(("g", "lam"), [(univariate("diffusion", 0.4), None), (univariate("diffusion", 0.4), 2.0), (multivariate("random_walk", 0.4, 0.2), 0.0)])
def test_gaussian(spark, graph, g, lam):
    df, y, s, x = problem(spark, 1)
    seen = s > 0
    loc, scale = y[seen].mean(), y[seen].std()
    normal = np.where(seen, (y - loc) / scale, 0.0)
    fitted = TableModel(df, graph, g, GAMMA, lam=lam).fit()
    if lam is None:
        want = dense.gsr(normal, s, prior_of(graph, g), GAMMA) * scale + loc
    else:
        b, w = dense.solve_rnc(normal, s, x, prior_of(graph, g), GAMMA, lam)
        want = (b + x @ w) * scale + loc
        assert np.abs(grid_of(fitted.cells, "b") - (b * scale + loc)).max() < 1e-5
        assert np.allclose([r["w"] for r in fitted.weights.orderBy("m").collect()], w * scale, atol=1e-5)
    assert np.abs(grid_of(fitted.cells) - want).max() < 1e-5


def test_splitting_equals_conjugate_gradients(spark, graph):
    g = custom(lambda lam, b: 1.3 / (1 + b * lam), 0.4)
    df, *_ = problem(spark, 9)
    one = TableModel(df, graph, g, GAMMA, solver="splitting").solve()
    other = TableModel(df, graph, g, GAMMA).solve()
    assert np.abs(grid_of(one) - grid_of(other)).max() < 1e-6
    with pytest.raises(ValueError, match="without features"):
        TableModel(df, graph, g, GAMMA, lam=1.0, solver="splitting")
    with pytest.raises(dense.NotConverged):
        tables.splitting(df.where("v is not null").select("ax0", "ax1", F.col("v").alias("y0")), tables.Prior.of(graph, g, GAMMA), max_iter=2)


@pytest.mark.parametrize("lam", [None, 1.5])
def test_logistic(spark, graph, lam):
    df, y, s, x = problem(spark, 2, labels=2)
    g = univariate("diffusion", 0.4)
    f = dense.lgsr(y, s, prior_of(graph, g), GAMMA) if lam is None else (lambda b, w: b + x @ w)(*dense.lrnc(y, s, x, prior_of(graph, g), GAMMA, lam))
    model = TableModel(df, graph, g, GAMMA, lam=lam, link="logistic")
    assert np.abs(grid_of(model.solve()) - dense.mu_logistic(f)).max() < 1e-5
    if lam is None:
        assert (grid_of(model.solve(classify=True)) == (f > 0)).all()


@pytest.mark.parametrize("lam", [None, 1.5])
def test_softmax(spark, graph, lam):
    df, y, s, x = problem(spark, 3, labels=3)
    df, x = df.withColumn("x", F.slice("x", 1, 1)), x[..., :1]
    g, hot = univariate("diffusion", 0.4), np.eye(3)[y.astype(int)] * s[..., None]
    f = dense.lgsr_multiclass(hot, s, prior_of(graph, g), GAMMA) if lam is None else (lambda b, w: b + x @ w)(*dense.lrnc_multiclass(hot, s, x, prior_of(graph, g), GAMMA, lam))
    out = TableModel(df, graph, g, GAMMA, lam=lam, link="softmax", classes=3).solve()
    got = np.zeros((*SHAPE, 3))
    for r in out.collect():
        got[r["ax0"], r["ax1"]] = r["p"]
    assert np.abs(got - dense.mu_softmax(f)).max() < 1e-5


def test_row_kernel_bounds_its_error(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((90, 2)), np.zeros((5, 2))])  # with repeated rows
    rows = spark.createDataFrame([(t, r.tolist()) for t, r in enumerate(x)], "t int, x array<double>").repartition(3)
    want, ranks = dense.rbf_kernel(x, 1.3), []
    for tol in (1e-2, 1e-5):
        kernel = tables.row_kernel(rows, 1.3, tol)
        u = np.zeros((len(x), kernel.rank))
        for r in kernel.factor.collect():
            u[r["t"], r["m"]] = r["u"]
        rest = want - u @ u.T
        assert np.linalg.norm(rest, 2) <= kernel.left + 1e-9 <= tol * len(x) + 1e-9
        assert np.trace(rest) == pytest.approx(kernel.left, abs=1e-8) and np.linalg.eigvalsh(rest).min() > -1e-8
        ranks.append(kernel.rank)
    assert ranks[0] < ranks[1] < len(x)


def test_kernel_axis(spark):
    rng, n = np.random.default_rng(5), 7
    x, y, s = rng.standard_normal((12, 2)), rng.standard_normal((12, n)), rng.random((12, n)) < 0.6
    graph, g = Graph.chain(spark, n), univariate("diffusion", 0.3)
    df = spark.createDataFrame([(t, i, float(y[t, i]) if s[t, i] else None) for t in range(12) for i in range(n)], "t int, ax0 int, v double")
    rows = spark.createDataFrame([(t, r.tolist()) for t, r in enumerate(x)], "t int, x array<double>")
    lam, v = np.linalg.eigh(dense.rbf_kernel(x, 1.0))
    loc, scale = y[s].mean(), y[s].std()
    want = dense.gsr(np.where(s, (y - loc) / scale, 0.0), s.astype(float), prior_of(graph, g).with_kernel(v, lam), GAMMA) * scale + loc
    got = {(r["t"], r["ax0"]): r["v"] for r in TableModel(df, graph, g, GAMMA, rows=rows).solve().collect()}
    assert len(got) == 12 * n and max(abs(got[t, i] - want[t, i]) for t in range(12) for i in range(n)) < 1e-4


def test_draws(spark, graph):
    df, y, s, x = problem(spark, 6)
    g, lam = univariate("diffusion", 0.4), 2.0
    scale = y[s > 0].std()
    exact = dense.marginal_variance(s, prior_of(graph, g), GAMMA, x, lam) * scale**2
    out = TableModel(df, graph, g, GAMMA, lam=lam).estimate_marginal_variance(16, seed=3)
    got, error = grid_of(out, "variance"), grid_of(out, "error")
    ratio = got / exact
    assert abs(ratio.mean() - 1) < 0.25 and (np.abs(ratio - 1) < 5 * np.sqrt(2 / 16)).all()
    assert np.allclose(error, got * np.sqrt(2 / 16))
    again = TableModel(df.drop("x").repartition(5), graph, g, GAMMA).sample(2, seed=3)
    first = TableModel(df.drop("x"), graph, g, GAMMA).sample(2, seed=3)
    both = again.join(first.withColumnRenamed("v", "w"), ["sample", "ax0", "ax1"])
    assert both.count() == 60 and both.agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0] < 1e-6


def test_refusals(spark, graph):
    df, *_ = problem(spark, 7)
    g = univariate("diffusion", 0.4)
    with pytest.raises(ValueError, match="whole numbers"):
        TableModel(df, graph, g, GAMMA, link="logistic").solve()
    with pytest.raises(ValueError, match="at least two classes"):
        TableModel(df, graph, g, GAMMA, link="softmax")
    with pytest.raises(ValueError, match="gamma"):
        TableModel(df, graph, g, 0.0)
    with pytest.raises(ValueError, match="Gaussian"):
        TableModel(df, graph, g, GAMMA, link="logistic").sample(1)
    with pytest.raises(dense.NotConverged):
        tables.newton(df.where("v is not null").select("ax0", "ax1", F.lit(1.0).alias("y0")), tables.Prior.of(graph, g, GAMMA), tables.Logistic(), 1, max_steps=1)
