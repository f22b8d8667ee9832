"""Graph Fourier transforms and filters of signals as joins and aggregations.

A signal is a table with one integer column for each graph axis, a value column and any other columns as
keys (classes, samples, groups), which are carried along. A mode product joins the basis of one axis and
adds up over the old coordinate; partial sums shrink the rows before the shuffle. The basis is broadcast
only if its size, known from the graph, is small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import Filter
from ..plans.lineage import cut
from .graphs import BROADCAST_ROWS, DENSE_NODES, AnyGraph, Graph, axes, grid, inside, matrix_table


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: One value column, or several that go through the same joins and sums.
Values = str | Sequence[str]


def _listed(value: Values) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def mode_product(signal: DataFrame, matrix: DataFrame, axis: str, old: str, new: str, rows: int, value: Values = "v") -> DataFrame:
    """Multiply along one axis: value(new) = sum over old of matrix(old, new) * value(old)."""
    values = _listed(value)
    keys = [c for c in signal.columns if c != axis and c not in values]
    m = _small(matrix.select(F.col(old).alias(axis), F.col(new).alias("_new"), F.col("u").alias("_u")), rows)
    product = signal.join(m, axis).groupBy(*keys, "_new").agg(*[F.sum(F.col(v) * F.col("_u")).alias(v) for v in values])
    return product.withColumnRenamed("_new", axis).select(*signal.columns)


def _order(graph: AnyGraph) -> list[int]:
    """Axes by size: the smallest first, so that the joins of the larger ones see no more rows than needed."""
    return sorted(range(graph.ndim), key=lambda a: graph.shape[a])


def gft(signal: DataFrame, graph: AnyGraph, value: Values = "v") -> DataFrame:
    """The graph Fourier transform: the axis columns become frequency numbers."""
    signal = inside(signal, graph)
    for a in _order(graph):
        f = graph.factors[a]
        signal = mode_product(signal, f.basis(), f"ax{a}", "i", "k", f.n * f.n, value)
    return signal


def rgft(signal: DataFrame, graph: AnyGraph, value: Values = "v") -> DataFrame:
    """The inverse transform."""
    for a in _order(graph):
        f = graph.factors[a]
        signal = mode_product(signal, f.basis(), f"ax{a}", "k", "i", f.n * f.n, value)
    return signal


def with_frequencies(signal: DataFrame, graph: AnyGraph) -> DataFrame:
    """A transformed signal with the frequency of each axis as lam0, lam1, ..."""
    for a, f in enumerate(graph.factors):
        spectrum = f.spectrum().select(F.col("k").alias(f"ax{a}"), F.col("lam").alias(f"lam{a}"))
        signal = signal.join(_small(spectrum, f.n), f"ax{a}")
    return signal


def gains(graph: AnyGraph, g: Filter) -> DataFrame:
    """ax0, ..., g: the gain of each frequency of the graph."""
    lams = [F.col(f"lam{a}") for a in range(graph.ndim)]
    return with_frequencies(grid(graph), graph).select(*axes(graph), g.column(*lams).alias("g"))


def gain_array(graph: AnyGraph, g: Filter) -> np.ndarray:
    """The gains as an array of the graph's shape."""
    lams = np.meshgrid(*(f.lam for f in graph.factors), indexing="ij")
    return np.broadcast_to(g.array(*lams), graph.shape).astype(float)


def scale_spectral(signal: DataFrame, graph: AnyGraph, gain: Column, value: Values = "v") -> DataFrame:
    """Transform, multiply by a gain (a column of lam0, lam1, ...), transform back.

    Frequencies whose gain is 0 are dropped between the transforms.
    """
    spectral = with_frequencies(gft(signal, graph, value), graph).withColumn("_g", gain).where("_g <> 0")
    scaled = spectral.withColumns({v: F.col(v) * F.col("_g") for v in _listed(value)}).select(*signal.columns)
    return rgft(scaled, graph, value)


#: Axes of more nodes than this have no basis tables (n * n rows); filters along them are polynomials.
SPECTRAL_NODES = 20_000


def beyond_bases(graph: AnyGraph) -> bool:
    """Whether an axis has no basis table: closed spectra from ``SPECTRAL_NODES`` on, others from ``DENSE_NODES`` on."""
    return any(f.n > (SPECTRAL_NODES if f.closed else DENSE_NODES) for f in graph.factors)


def filter_signal(signal: DataFrame, graph: AnyGraph, g: Filter, power: float | None = None, value: str = "v") -> DataFrame:
    """g(L) applied to a signal, or a power of it.

    A separable filter is one matrix for each axis, so that an axis takes one join and sum instead of two.
    Univariate filters on graphs with an axis too long for basis tables are Chebyshev polynomials, to a stated error.
    """
    if beyond_bases(graph) and not g.multivariate:
        return chebyshev(signal, graph, g, value=value, power=power)
    matrices = kernels(graph, g, power)
    if matrices is not None:
        return apply_kernels(inside(signal, graph), matrices, value)
    gain = g.column(*[F.col(f"lam{a}") for a in range(graph.ndim)])
    return scale_spectral(signal, graph, gain if power is None else F.pow(gain, F.lit(float(power))), value)


def kernels(graph: AnyGraph, g: Filter, power: float | None = None) -> list[tuple[str, DataFrame, int]] | None:
    """(axis, kernel, rows) of each axis for a filter that is a product over the axes, the smallest first; else None."""
    if not (g.separable and g.name == "diffusion" and (power is None or power > 0)):
        return None
    betas = g.beta if g.multivariate else g.beta * graph.ndim
    if len(betas) != graph.ndim:
        raise ValueError(f"the filter is made for {len(betas)} axes, the graph has {graph.ndim}")
    return [(f"ax{a}", axis_kernel(graph.factors[a], F.exp(-F.col("lam") * (betas[a] * (power or 1)))), graph.factors[a].n ** 2) for a in _order(graph)]


def apply_kernels(signal: DataFrame, matrices: list[tuple[str, DataFrame, int]], value: Values = "v") -> DataFrame:
    for axis, kernel, rows in matrices:
        signal = mode_product(signal, kernel, axis, "i", "j", rows, value)
    return signal


def axis_kernel(factor: Graph, gain: Column) -> DataFrame:
    """i, j, u: the matrix of a gain (a column of lam) on one factor, in n * n steps for closed spectra.

    A loop's kernel depends on i - j alone; a chain's is the sum of such a function at i - j and i + j + 1; a
    complete graph's has one value on the diagonal and one beside it.
    """
    n, spark = factor.n, factor.spark
    if not factor.closed:  # at most DENSE_NODES frequencies
        g = np.array([r[0] for r in factor.spectrum().orderBy("k").select(gain.cast("double")).collect()])
        return matrix_table(spark, (factor.u * g) @ factor.u.T)
    pairs = spark.range(n).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if factor.kind == "complete":
        two = spark.range(2).select((F.col("id") * float(n)).alias("lam")).select("lam", gain.alias("g"))
        two = two.agg(F.sum(F.when(F.col("lam") == 0, F.col("g"))).alias("g0"), F.sum(F.when(F.col("lam") > 0, F.col("g"))).alias("g1"))
        two = two.select("g0", F.coalesce("g1", F.lit(0.0)).alias("g1"))
        u = (F.col("g0") - F.col("g1")) / n + F.when(F.col("i") == F.col("j"), F.col("g1")).otherwise(0.0)
        return pairs.join(F.broadcast(two), how="cross").select("i", "j", u.alias("u"))  # one row
    period, half = (2 * n, 0.5) if factor.kind == "chain" else (n, 1.0)
    turns = F.col("k") if factor.kind == "chain" else F.ceil(F.col("k") / 2)
    weight = F.when(F.col("k") == 0, 1 / n).otherwise(2 / n) * half if factor.kind == "chain" else F.lit(1 / n)
    waves = factor.spectrum().select(turns.alias("f"), (gain * weight).alias("g")).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(period - 1))))
    c = waves.groupBy("m").agg(F.sum(F.col("g") * F.cos(2 * np.pi / period * F.pmod(F.col("f") * F.col("m"), F.lit(period)))).alias("c"))
    held = _small(c, period)
    near = pairs.withColumn("m", F.abs(F.col("i") - F.col("j"))).join(held, "m").select("i", "j", F.col("c").alias("u"))
    if factor.kind == "loop":
        return near
    mirrored = _small(c.select(F.col("m").alias("m2"), F.col("c").alias("c2")), period)
    return near.withColumn("m2", F.col("i") + F.col("j") + 1).join(mirrored, "m2").select("i", "j", (F.col("u") + F.col("c2")).alias("u"))


def laplacian_product(signal: DataFrame, graph: AnyGraph, value: str = "v") -> DataFrame:
    """L applied to a signal by joins with the edges of each axis; no basis is needed."""
    keys = [c for c in signal.columns if c != value]
    parts = []
    for a, f in enumerate(graph.factors):
        lap = f.laplacian().select(F.col("j").alias(f"ax{a}"), F.col("i").alias("_new"), F.col("w").alias("_w"))
        moved = signal.join(lap, f"ax{a}").withColumn(value, F.col(value) * F.col("_w")).drop(f"ax{a}", "_w").withColumnRenamed("_new", f"ax{a}")
        parts.append(moved.select(*signal.columns))
    # axes without an edge at a node add nothing to it, but the node stays
    parts.append(signal.withColumn(value, F.lit(0.0)))
    return reduce(DataFrame.union, parts).groupBy(*keys).agg(F.sum(value).alias(value)).select(*signal.columns)


def smoothness(signal: DataFrame, graph: AnyGraph, by: Sequence[str] = (), value: str = "v") -> DataFrame:
    """The quadratic form y' L y of each group of key columns: half the weighted squared differences."""
    parts = []
    for a, f in enumerate(graph.factors):
        keys = [c for c in signal.columns if c not in (value, f"ax{a}")]
        other = signal.select(*keys, F.col(f"ax{a}").alias("dst"), F.col(value).alias("_v2"))
        e = f.edges.where("src < dst").withColumnRenamed("src", f"ax{a}")
        pairs = signal.join(e, f"ax{a}").join(other, [*keys, "dst"])
        parts.append(pairs.select(*by, (F.col("w") * F.pow(F.col(value) - F.col("_v2"), 2)).alias("q")))
    total = reduce(DataFrame.union, parts)
    return total.groupBy(*by).agg(F.sum("q").alias("smoothness")) if by else total.agg(F.sum("q").alias("smoothness"))


def outer_product(one: DataFrame, other: DataFrame, value: str = "v") -> DataFrame:
    """The tensor product of two signals with different axis columns; the second is broadcast if Spark finds it small."""
    right = other.withColumnRenamed(value, "_v2")
    keys = [c for c in one.columns + other.columns if c != value]
    return one.join(right, how="cross").select(*keys, (F.col(value) * F.col("_v2")).alias(value))


def expand_axis(signal: DataFrame, name: str, at: int = 0) -> DataFrame:
    """Another axis column of one coordinate."""
    return signal.withColumn(name, F.lit(at))


def flat_id(graph: AnyGraph) -> Column:
    """The row-major number of a node."""
    out = F.col("ax0").cast("long")
    for a, n in enumerate(graph.shape[1:], 1):
        out = out * n + F.col(f"ax{a}")
    return out


def unflatten(flat: Column, graph: AnyGraph) -> list[Column]:
    """The axis coordinates of a row-major number."""
    out, rest = [], flat
    for a in range(graph.ndim - 1, -1, -1):
        n = graph.shape[a]
        out.append(F.pmod(rest, F.lit(n)).cast("int").alias(f"ax{a}"))
        rest = F.floor(rest / n)
    return out[::-1]


#: Steps of a recurrence between two cuts of its lineage.
CUT_EVERY = 5


#: The largest error of a polynomial gain, and the largest degree, by which filters on large graphs are made.
GAIN_ERROR, MAX_DEGREE = 1e-8, 400


def largest_frequency(graph: AnyGraph) -> float:
    """A bound on the frequencies: 4 for chains and loops, n for complete graphs, twice the largest degree for others."""
    top = 0.0
    for f in graph.factors:
        known = {"chain": 4.0, "loop": 4.0, "complete": float(f.n)}
        top += known[f.kind] if f.kind in known else 2 * (f.degrees().agg(F.max("degree")).first()[0] or 0.0)
    return top or 1.0


def chebyshev_coefficients(gain: Callable[[np.ndarray], np.ndarray], top: float, degree: int | None = None, error: float = GAIN_ERROR) -> list[float]:
    """Coefficients of a gain on [0, top]; without a degree, as many as it takes for an error below ``error``.

    The polynomial differs from the gain by at most the sum of the coefficients that are left out. These are told
    from eight times as many terms as are allowed; a gain whose terms don't fade by then (a step, a kink) is refused.
    """
    n = degree + 1 if degree is not None else 8 * MAX_DEGREE
    angles = np.pi * (np.arange(n) + 0.5) / n
    values = gain((np.cos(angles) + 1) * top / 2)
    if degree is not None:
        return [2 / n * float((values * np.cos(j * angles)).sum()) for j in range(n)]
    c = np.array([2 / n * float((values * np.cos(j * angles)).sum()) for j in range(n)])
    left = np.cumsum(np.abs(c[::-1]))[::-1]  # of this term and those after it
    # terms beyond these fold into them: what the last eighth holds tells how slowly they fade
    enough = np.flatnonzero(left <= error / 2)
    if not len(enough) or enough[0] > MAX_DEGREE + 1 or left[-n // 8] > error / 100:
        raise ValueError(f"a polynomial of {MAX_DEGREE} terms doesn't come within {error} of this gain on frequencies up to {top}")
    return c[: max(1, int(enough[0]))].tolist()


def chebyshev(signal: DataFrame, graph: AnyGraph, g: Filter, degree: int | None = None, value: str = "v", power: float | None = None) -> DataFrame:
    """g(L) for a univariate filter by a Chebyshev polynomial: edge joins only, for graphs too large to decompose.

    Without a degree the gain is met to ``GAIN_ERROR`` at every frequency, or the filter is refused.

    A step of the three-term recurrence is one pass: each cell sends its value to its neighbours (lists joined
    by node, broadcast where they are small) and itself, and one sum gathers them. The state is cut at the
    checkpoint folder every few steps.
    """
    if g.multivariate:
        raise ValueError("a polynomial in the whole Laplacian takes a univariate filter")
    top = largest_frequency(graph)  # the axes add up
    c = chebyshev_coefficients(lambda lam: g.array(lam) ** (1.0 if power is None else power), top, degree)
    degree = len(c) - 1
    names, keys = axes(graph), [k for k in signal.columns if k != value]
    near = [cut(f.neighbours()) if f.kind == "edges" else f.neighbours() for f in graph.factors]
    sizes = [{"chain": 3, "loop": 3}.get(f.kind, f.n) * f.n for f in graph.factors]

    def step(state: DataFrame, j: int) -> DataFrame:
        moved = F.array(F.struct(*names, (F.col("_a") * F.lit(0.0)).alias("l"), F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_out").alias("o")))
        zero = F.lit(0.0)
        for a, (lists, size) in enumerate(zip(near, sizes)):
            state = state.join(_small(lists.select(F.col("node").alias(f"ax{a}"), F.col("near").alias(f"_near{a}")), size), f"ax{a}", "left")
            lists_of = F.coalesce(F.col(f"_near{a}"), F.array().cast("array<struct<dst:int,w:double>>"))
            at = lambda e, a=a: [e["dst"].cast("int").alias(n) if n == f"ax{a}" else F.col(n).alias(n) for n in names]
            sent = F.transform(lists_of, lambda e: F.struct(*at(e), (-e["w"] * F.col("_a")).alias("l"), zero.alias("a"), zero.alias("b"), zero.alias("o")))
            own = F.array(F.struct(*names, (F.aggregate(lists_of, zero, lambda x, e: x + e["w"]) * F.col("_a")).alias("l"), zero.alias("a"), zero.alias("b"), zero.alias("o")))
            moved = F.concat(moved, sent, own)
        others = [k for k in keys if k not in names]
        sums = state.select(*others, F.inline(moved)).groupBy(*keys).agg(*[F.sum(x).alias(x) for x in "labo"])
        scaled = F.col("l") * (2 / top) - F.col("a")
        new = scaled if j == 1 else 2 * scaled - F.col("b")
        return sums.select(*keys, new.alias("_a"), F.col("a").alias("_b"), (F.col("o") + new * c[j]).alias("_out"))

    state = inside(signal, graph).select(*keys, F.col(value).cast("double").alias("_a"), F.lit(0.0).alias("_b"), (F.col(value) * (c[0] / 2)).alias("_out"))
    for j in range(1, degree + 1):
        state = step(state, j)
        if j % CUT_EVERY == 0 and j < degree:
            state = cut(state)
    return state.select(*keys, F.col("_out").alias(value)).select(*signal.columns)
