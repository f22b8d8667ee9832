"""Models of signals that no task can hold: Gaussian, logistic and softmax, with features, kernel axes and draws.

With K = H^2 / gamma and f = K a + X w, the maximum has a = y - mu(f) on the observed cells, 0 elsewhere, and
X' a = lam w. A Newton step with the weights W = R R' (1, mu (1 - mu), or diag(mu) - mu mu' of each cell) solves
(I + W K) a = b, b = W f + y - mu, as a = b - R (I + R' K R)^-1 R' K b: symmetric, well-conditioned, never
divided by a weight. The weights w of M features take M more right-hand sides W X, and a system of M rows, whose
matrix is one aggregate (Schur complement). A Gaussian model is the one step with W = 1.

The state is one row for each observed cell. All right-hand sides, and all classes, are columns of it: K is
applied to all of them by the same joins and sums. Conjugate gradients have step lengths for each right-hand
side; one that has converged leaves the joins. Inner products are taken while the state is written to the
checkpoint folder, so that a step is one job, and a lost executor costs one step. Newton steps start from the
solution of the step before and stop by the mean change of f, which is observed in the same way.

A kernel over rows with covariates is a pivoted incomplete Cholesky factor: blocks of the rows with the largest
residuals become pivots until the residuals add up to less than a tolerance times the number of rows. What is
left out has no eigenvalue above that sum.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.filters import NAMES, Filter
from ..plans.lineage import cut
from ..sources.signals import postprocess, require_double, statistics
from .dense import NotConverged
from .graphs import AnyGraph, axes, grid, inside
from .models import Fitted
from .transform import apply_kernels, beyond_bases, chebyshev, kernels, mode_product, scale_spectral, with_frequencies

#: Draws that are solved together.
BLOCK = 16
#: Pivots that a pass over the rows of a kernel adds.
PIVOTS = 16


# ---- kernels over rows -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class RowKernel:
    """A kernel over the rows t as a factor (t, m, u) with K = U U' but for ``left``, the trace of the rest."""

    factor: DataFrame
    rows: int
    rank: int
    left: float


def row_kernel(rows: DataFrame, std: float, tol: float = 1e-9, max_rank: int = 2000) -> RowKernel:
    """The RBF kernel of rows (t, x: an array of doubles), to a trace of ``tol`` times the number of rows.

    A pass over the rows adds up to ``PIVOTS`` columns; only the pivots come to the driver.
    """
    require_double(rows, "x")
    count = Observation()
    state = cut(rows.select(F.col("t").cast("int").alias("t"), "x", F.array().cast("array<double>").alias("l"), F.lit(1.0).alias("d")).observe(count, F.count(F.lit(1)).alias("n"), F.sum("d").alias("left")))
    n, left, rank = count.get["n"], count.get["left"] or 0.0, 0

    def similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        square = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T
        return np.exp(-np.maximum(square, 0) / (2 * std * std))

    while left > tol * n:
        if rank >= max_rank:
            raise NotConverged(f"a rank of {max_rank} leaves a trace of {left}")
        top = state.orderBy(F.desc("d"), "t").limit(PIVOTS).collect()
        x_p, l_p = np.array([r["x"] for r in top], float), np.array([r["l"] for r in top], float).reshape(len(top), rank)
        block, chosen, d = similar(x_p, x_p) - l_p @ l_p.T, [], None
        c = np.zeros((len(top), 0))
        while len(chosen) < len(top):  # the pivots among the candidates, the largest residual first
            d = np.diag(block) - (c * c).sum(1)
            i = int(np.argmax(d))
            if d[i] <= max(tol, 1e-3 * top[0]["d"]):
                break
            c = np.hstack([c, ((block[:, i] - c @ c[i]) / math.sqrt(d[i]))[:, None]])
            chosen.append(i)
        if not chosen:
            break
        x_p, l_p, root = x_p[chosen], l_p[chosen], np.tril(c[chosen])

        def add(batches: Iterator[pa.RecordBatch], x_p=x_p, l_p=l_p, root=root, rank=rank) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, old = (np.array(batch.column(c).to_pylist(), float) for c in ("x", "l"))
                old = old.reshape(len(x), rank)
                new = np.linalg.solve(root, (similar(x, x_p) - old @ l_p.T).T).T
                d = np.maximum(batch.column("d").to_numpy() - (new * new).sum(1), 0)
                yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("x"), pa.array(np.hstack([old, new]).tolist(), pa.list_(pa.float64())), pa.array(d)], names=["t", "x", "l", "d"])

        sums = Observation()
        state = cut(state.mapInArrow(add, state.schema).observe(sums, F.sum("d").alias("left")))
        left, rank = sums.get["left"], rank + len(chosen)
    return RowKernel(cut(state.select("t", F.posexplode("l").alias("m", "u"))), n, rank, left)


# ---- the prior -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Prior:
    """The prior of b: H^2 / gamma on the axes of a graph, times a kernel over the rows t if there is one."""

    graph: AnyGraph
    filter: Filter
    gamma: float
    kernel: RowKernel | None
    #: The kernels of the axes, where the filter is a product over them, for H^2 and for H.
    held: dict[float, list | None]

    @classmethod
    def of(cls, graph: AnyGraph, g: Filter, gamma: float, kernel: RowKernel | None = None, draws: bool = False) -> Prior:
        held: dict[float, list | None] = {}
        for power in (2.0, 1.0) if draws else (2.0,):
            matrices = None if beyond_bases(graph) else kernels(graph, g, power)
            held[power] = matrices and [(axis, cut(k), rows) for axis, k, rows in matrices]
        return cls(graph, g, gamma, kernel, held)

    @property
    def keys(self) -> list[str]:
        return (["t"] if self.kernel else []) + axes(self.graph)

    def _filtered(self, signal: DataFrame, values: list[str], power: float) -> DataFrame:
        if self.held[power] is not None:
            return apply_kernels(signal, self.held[power], values)
        if beyond_bases(self.graph) and not self.filter.multivariate:
            keys = [c for c in signal.columns if c not in values]
            long = signal.select(*keys, F.posexplode(F.array(*values)).alias("_value", "v"))
            out = chebyshev(long, self.graph, self.filter, power=power)
            return out.groupBy(*keys).agg(*[F.max(F.when(F.col("_value") == k, F.col("v"))).alias(v) for k, v in enumerate(values)])
        gain = self.filter.column(*[F.col(f"lam{a}") for a in range(self.graph.ndim)])
        return scale_spectral(signal, self.graph, F.pow(gain, F.lit(power)), values)

    def apply(self, signal: DataFrame, values: list[str]) -> DataFrame:
        """K times each value column of a signal (the keys and these columns), on all cells that it reaches."""
        scaled = signal.select(*self.keys, *[(F.col(v) / self.gamma).alias(v) for v in values])
        if self.kernel:
            entries = self.kernel.rows * self.kernel.rank
            scaled = mode_product(scaled, self.kernel.factor, "t", "t", "m", entries, values)
            scaled = self._filtered(scaled, values, 2.0)
            return mode_product(scaled, self.kernel.factor, "t", "m", "t", entries, values)
        return self._filtered(scaled, values, 2.0)

    def draw(self, seed: int, draws: Sequence[int]) -> DataFrame:
        """Draws of the prior, g0, g1, ... on all cells: by numbers that depend on seed, draw and cell alone."""
        cells, values = grid(self.graph), [f"g{k}" for k in range(len(draws))]
        if self.kernel:
            cells = cells.select(F.explode(F.sequence(F.lit(0), F.lit(self.kernel.rank - 1))).alias("t"), "*")
        noise = cells.select(*self.keys, *[(normal(seed, n, 0, *self.keys) / math.sqrt(self.gamma)).alias(v) for n, v in zip(draws, values)])
        out = self._filtered(noise, values, 1.0)
        return mode_product(out, self.kernel.factor, "t", "m", "t", self.kernel.rows * self.kernel.rank, values) if self.kernel else out


def normal(seed: int, draw: int, part: int, *keys: str) -> Column:
    """A standard normal number that depends on its arguments alone, whatever the partitions."""
    one, two = ((F.pmod(F.xxhash64(F.lit(seed), F.lit(draw), F.lit(2 * part + i), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52) for i in (0, 1))
    return F.sqrt(-2 * F.log(one)) * F.cos(2 * math.pi * two)


# ---- links -----------------------------------------------------------------------------------------------


class Gaussian:
    """Values themselves."""

    def mean(self, f: list[Column]) -> list[Column]:
        return f

    def roots(self, mu: list[Column]) -> list[Column]:
        return []

    def weight(self, mu: list[Column], v: list[Column]) -> list[Column]:
        return v


class Logistic:
    """Labels 0 and 1."""

    def mean(self, f: list[Column]) -> list[Column]:
        return [1 / (1 + F.exp(-f[0]))]

    def roots(self, mu: list[Column]) -> list[Column]:
        return [F.sqrt(mu[0] * (1 - mu[0]))]

    def weight(self, mu: list[Column], v: list[Column]) -> list[Column]:
        return [mu[0] * (1 - mu[0]) * v[0]]

    def root(self, q: list[Column], v: list[Column]) -> list[Column]:
        return [q[0] * v[0]]

    root_t = root


class Softmax:
    """One column for each class."""

    def mean(self, f: list[Column]) -> list[Column]:
        top = F.greatest(*f) if len(f) > 1 else f[0]
        e = [F.exp(x - top) for x in f]
        return [x / _total(e) for x in e]

    def roots(self, mu: list[Column]) -> list[Column]:
        return [F.sqrt(m) for m in mu]

    def weight(self, mu: list[Column], v: list[Column]) -> list[Column]:
        inner = _total([m * x for m, x in zip(mu, v)])
        return [m * (x - inner) for m, x in zip(mu, v)]

    def root(self, q: list[Column], v: list[Column]) -> list[Column]:
        inner = _total([a * x for a, x in zip(q, v)])
        return [a * (x - a * inner) for a, x in zip(q, v)]

    def root_t(self, q: list[Column], v: list[Column]) -> list[Column]:
        inner = _total([a * a * x for a, x in zip(q, v)])
        return [a * x - a * inner for a, x in zip(q, v)]


def _total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


# ---- solvers ---------------------------------------------------------------------------------------------


def _names(kind: str, sides: Sequence[int], classes: int) -> list[str]:
    return [f"{kind}{k}_{c}" for k in sides for c in range(classes)]


def _cols(kind: str, k: int, classes: int) -> list[Column]:
    return [F.col(f"{kind}{k}_{c}") for c in range(classes)]


def _dot(one: list[Column], other: list[Column]) -> Column:
    return F.sum(_total([a * b for a, b in zip(one, other)]))


def conjugate_gradients(state: DataFrame, prior: Prior, link, roots: list[str], sides: int, classes: int, scales: list[float] | None = None, tol: float = 1e-8, max_iter: int = 500) -> tuple[DataFrame, list[float]]:
    """Solve (I + R' K R) x = r for each right-hand side: ``state`` has the keys, the roots of the weights, x and r.

    x is added to what the columns x0_0, ... hold, r0_0, ... are the residuals of these; all other columns are kept. A
    right-hand side is done when its residual is ``tol`` times its scale (by default its first residual). Also
    returns the scales.
    """
    keys, q = prior.keys, [F.col(c) for c in roots]
    kept = [c for c in state.columns if c not in _names("r", range(sides), classes) + _names("x", range(sides), classes)]

    def written(state: DataFrame, active: list[int]) -> tuple[DataFrame, dict]:
        """state with w = (I + R' K R) r of the active sides, cut, and their (r, r) and (r, w)."""
        sent = [(link.root(q, _cols("r", k, classes)) if roots else _cols("r", k, classes)) for k in active]
        names = _names("_k", active, classes)
        moved = prior.apply(state.select(*keys, *[c.alias(n) for c, n in zip([c for s in sent for c in s], names)]), names)
        whole = state.join(moved, keys)
        for k in active:
            back = link.root_t(q, _cols("_k", k, classes)) if roots else _cols("_k", k, classes)
            whole = whole.withColumns({f"w{k}_{c}": F.col(f"r{k}_{c}") + b for c, b in enumerate(back)})
        sums = Observation()
        metrics = [e for k in active for e in (_dot(_cols("r", k, classes), _cols("r", k, classes)).alias(f"rr{k}"), _dot(_cols("r", k, classes), _cols("w", k, classes)).alias(f"rw{k}"))]
        out = cut(whole.drop(*names).observe(sums, *metrics))
        return out, sums.get

    active = list(range(sides))
    zero = F.lit(0.0)
    state = state.withColumns({n: zero for kind in "ps" for n in _names(kind, active, classes)})
    state, found = written(state, active)
    rr = {k: found[f"rr{k}"] or 0.0 for k in active}
    rw = {k: found[f"rw{k}"] or 0.0 for k in active}
    scales = scales or [rr[k] for k in active]
    alpha, beta = {k: rr[k] / rw[k] if rw[k] else 0.0 for k in active}, {k: 0.0 for k in active}
    for _ in range(max_iter):
        active = [k for k in active if rr[k] > tol * tol * scales[k]]
        if not active:
            return state.select(*kept, *_names("x", range(sides), classes)), scales
        moved = {}
        for k in active:
            for c in range(classes):
                p = F.col(f"r{k}_{c}") + beta[k] * F.col(f"p{k}_{c}")
                s = F.col(f"w{k}_{c}") + beta[k] * F.col(f"s{k}_{c}")
                moved |= {f"x{k}_{c}": F.col(f"x{k}_{c}") + alpha[k] * p, f"r{k}_{c}": F.col(f"r{k}_{c}") - alpha[k] * s, f"p{k}_{c}": p, f"s{k}_{c}": s}
        wanted = [*kept, *_names("x", range(sides), classes), *(n for kind in "rps" for n in _names(kind, active, classes))]
        before = rr
        state, found = written(state.withColumns(moved).select(*wanted), active)
        rr, rw = {k: found[f"rr{k}"] or 0.0 for k in active}, {k: found[f"rw{k}"] or 0.0 for k in active}
        beta = {k: rr[k] / before[k] for k in active}
        alpha = {k: rr[k] / d if rr[k] and (d := rw[k] - beta[k] * rr[k] / alpha[k]) else 0.0 for k in active}
    raise NotConverged(f"no solution after {max_iter} steps")


@dataclass(frozen=True)
class Solution:
    """a of each observed cell, for each right-hand side (a0_0, ...), and the weights of the features of each."""

    cells: DataFrame
    weights: list[np.ndarray]


def gaussian(seen: DataFrame, prior: Prior, features: int, lam: float, sides: int = 1, tol: float = 1e-9) -> Solution:
    """Solve (K + I) a + X w = y, X' a = lam w for each of y0, y1, ...; ``seen``: the keys, these, and features z0, z1, ..."""
    sources = [f"y{k}" for k in range(sides)] + [f"z{m}" for m in range(features)]
    start = seen.select(*prior.keys, *[f"z{m}" for m in range(features)], *[F.col(c).alias(f"r{k}_0") for k, c in enumerate(sources)], *[F.lit(0.0).alias(f"x{k}_0") for k in range(len(sources))])
    state, _ = conjugate_gradients(start, prior, Gaussian(), [], len(sources), 1, tol=tol)
    if not features:
        return Solution(state.select(*prior.keys, *[F.col(f"x{k}_0").alias(f"a{k}_0") for k in range(sides)]), [np.zeros((0, 1))] * sides)
    gram = _gram(state, features, [f"x{k}_0" for k in range(len(sources))])
    matrix = gram[:, sides:] + lam * np.eye(features)
    weights = [np.linalg.lstsq(matrix, gram[:, k], rcond=None)[0][:, None] for k in range(sides)]
    a = [_total([F.col(f"x{k}_0")] + [F.col(f"x{sides + m}_0") * -float(weights[k][m, 0]) for m in range(features)]) for k in range(sides)]
    return Solution(state.select(*prior.keys, *[c.alias(f"a{k}_0") for k, c in enumerate(a)]), weights)


def _gram(state: DataFrame, features: int, columns: list[str]) -> np.ndarray:
    """The sums of each feature times each column: one aggregate, a few numbers."""
    row = state.agg(*[F.sum(F.col(f"z{m}") * F.col(c)).alias(f"{m}_{c}") for m in range(features) for c in columns]).first()
    return np.array([x or 0.0 for x in row]).reshape(features, len(columns))


def splitting(seen: DataFrame, prior: Prior, tol: float = 1e-9, max_iter: int = 2000) -> DataFrame:
    """a of (K + I) a = y by the splitting (K + I) = M - N with M = m I: a <- a + (y - (K + I) a) / m.

    With m = 1 + t / 2, where t bounds the eigenvalues of K, the error shrinks by t / (t + 2) in each step. A step is one
    job: the change and its norm, by which the iteration stops, come from the write of the new state. ``seen``: the
    keys and y0; no inner products are needed, so that steps don't wait for the driver's arithmetic on them.
    """
    if prior.kernel:
        raise ValueError("splitting needs a bound on the eigenvalues; kernel axes have none here")
    keys, top = prior.keys, largest_gain(prior.graph, prior.filter) ** 2 / prior.gamma
    m = 1 + top / 2
    state = cut(seen.select(*keys, F.col("y0").alias("r"), F.lit(0.0).alias("a")))
    start = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    size = start
    for _ in range(max_iter):
        if size <= tol * tol * start:
            return state.select(*keys, F.col("a").alias("a0_0"))
        moved = prior.apply(state.select(*keys, (F.col("r") / m).alias("_d")), ["_d"]).withColumnRenamed("_d", "_k")
        step = F.col("r") / m
        norm = Observation()
        new = state.join(moved, keys).select(*keys, (F.col("r") - step - F.col("_k")).alias("r"), (F.col("a") + step).alias("a"))
        state = cut(new.observe(norm, F.sum(F.col("r") * F.col("r")).alias("size")))
        size = norm.get["size"] or 0.0
    raise NotConverged(f"no solution after {max_iter} steps")


def largest_gain(graph: AnyGraph, g: Filter) -> float:
    """The largest gain of a filter on a graph; the named ones have it, 1, at frequency 0."""
    if g.name in NAMES:
        return 1.0
    cells = with_frequencies(grid(graph), graph)
    return float(cells.agg(F.max(F.abs(g.column(*[F.col(f"lam{a}") for a in range(graph.ndim)])))).first()[0])


def newton(seen: DataFrame, prior: Prior, link, classes: int, features: int = 0, lam: float = 0.0, tol: float = 1e-6, inner: float = 1e-8, max_steps: int = 50) -> Solution:
    """The maximum for labels under a link; ``seen``: the keys, y0 ... for the classes, and features z0, z1, ..."""
    keys, n_w = prior.keys, features * classes
    sides = 1 + n_w
    y, z, f = [F.col(f"y{c}") for c in range(classes)], [F.col(f"z{m}") for m in range(features)], [F.col(f"f{c}") for c in range(classes)]
    mu = link.mean(f)
    roots = [f"q{i}" for i in range(len(link.roots(mu)))]
    given = [*keys, *[f"y{c}" for c in range(classes)], *[f"z{m}" for m in range(features)]]
    state = cut(seen.select(*given, *[F.lit(0.0).alias(f"f{c}") for c in range(classes)], *[F.lit(0.0).alias(n) for n in _names("x", range(sides), classes)]))
    scales = None
    for _ in range(max_steps):
        # the right-hand sides: b, and the weighted features of each class
        b = [u + v - m for u, v, m in zip(link.weight(mu, f), y, mu)]
        values = dict(zip(_names("v", [0], classes), b))
        for m in range(features):
            for c in range(classes):
                unit = [z[m] if c == other else F.lit(0.0) for other in range(classes)]
                values |= dict(zip(_names("v", [1 + m * classes + c], classes), link.weight(mu, unit)))
        held = state.select(*given, *[f"f{c}" for c in range(classes)], *_names("x", range(sides), classes), *[c.alias(n) for c, n in zip(link.roots(mu), roots)], *[c.alias(n) for n, c in values.items()])
        q = [F.col(c) for c in roots]
        # residuals of the solutions of the step before: R' K (v - R x) - x
        rest, names = [], _names("_k", range(sides), classes)
        for k in range(sides):
            rest += [v - r for v, r in zip(_cols("v", k, classes), link.root(q, _cols("x", k, classes)))]
        moved = prior.apply(held.select(*keys, *[c.alias(n) for c, n in zip(rest, names)]), names)
        start = held.join(moved, keys)
        for k in range(sides):
            back = link.root_t(q, _cols("_k", k, classes))
            start = start.withColumns({f"r{k}_{c}": x - F.col(f"x{k}_{c}") for c, x in enumerate(back)})
        solved, scales = conjugate_gradients(start.drop(*names), prior, link, roots, sides, classes, scales, inner)
        solved = solved.withColumns({f"a{k}_{c}": v - r for k in range(sides) for c, (v, r) in enumerate(zip(_cols("v", k, classes), link.root(q, _cols("x", k, classes))))})
        a, w = _cols("a", 0, classes), np.zeros((0, classes))
        if features:
            gram = _gram(solved, features, _names("a", range(sides), classes)).reshape(features, sides, classes)
            gram = np.moveaxis(gram, 1, 2).reshape(n_w, sides)  # rows: feature and class
            flat = np.linalg.lstsq(gram[:, 1:] + lam * np.eye(n_w), gram[:, 0], rcond=None)[0]
            w = flat.reshape(features, classes)
            a = [_total([x, *(F.col(f"a{1 + j}_{c}") * -float(flat[j]) for j in range(n_w))]) for c, x in enumerate(a)]
        names = [f"_a{c}" for c in range(classes)]
        solved = cut(solved.select(*given, *[f"f{c}" for c in range(classes)], *_names("x", range(sides), classes), *[c.alias(n) for c, n in zip(a, names)]))
        new = solved.join(prior.apply(solved.select(*keys, *[F.col(n).alias(n.replace("_a", "_f")) for n in names]), [n.replace("_a", "_f") for n in names]), keys)
        total = [_total([F.col(f"_f{c}"), *(z[m] * float(w[m, c]) for m in range(features))]) for c in range(classes)]
        change = Observation()
        new = new.observe(change, F.avg(_total([F.abs(t - x) for t, x in zip(total, f)]) / classes).alias("change"))
        state = cut(new.select(*given, *names, *[t.alias(f"f{c}") for c, t in enumerate(total)], *_names("x", range(sides), classes)))
        if (change.get["change"] or 0.0) <= tol:
            return Solution(state.select(*keys, *[F.col(n).alias(f"a0_{c}") for c, n in enumerate(names)]), [w])
    raise NotConverged(f"no solution after {max_steps} Newton steps")


# ---- models ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TableModel:
    """One problem over tables. ``y``: the axes (t first, with ``rows``), v with NULL for missing cells, and x with ``lam``.

    ``lam``: the ridge penalty on the weights of the features x (an array of doubles in each cell); without it features
    aren't used. ``rows``: a table (t, x) of the covariates of a kernel axis. ``classes``: 1 for values, 2 for labels 0
    and 1 (logistic), ``classes`` with ``softmax`` for labels 0 to classes - 1.
    """

    y: DataFrame
    graph: AnyGraph
    filter: Filter
    gamma: float
    lam: float | None = None
    rows: DataFrame | None = None
    kernel_std: float = 1.0
    kernel_tol: float = 1e-9
    link: str = "gaussian"
    classes: int = 1
    #: "conjugate gradients", or "splitting" for Gaussian models without features.
    solver: str = "conjugate gradients"

    def __post_init__(self) -> None:
        if self.gamma <= 0 or (self.lam is not None and self.lam < 0):
            raise ValueError("gamma must be positive, lam must not be negative")
        if self.link not in ("gaussian", "logistic", "softmax") or (self.link == "softmax") != (self.classes > 1):
            raise ValueError("the link is gaussian or logistic, or softmax with at least two classes")
        if self.solver not in ("conjugate gradients", "splitting") or self.solver == "splitting" and (self.link != "gaussian" or self.lam is not None):
            raise ValueError("splitting is for Gaussian models without features")
        require_double(self.y, "v", *(["x"] if self.lam is not None else []))

    def with_gamma(self, gamma: float) -> TableModel:
        return replace(self, gamma=gamma)

    def prior(self, draws: bool = False) -> Prior:
        kernel = row_kernel(self.rows, self.kernel_std, self.kernel_tol) if self.rows is not None else None
        return Prior.of(self.graph, self.filter, self.gamma, kernel, draws)

    def _features(self) -> int:
        return 0 if self.lam is None else len(self.y.select("x").first()["x"])

    def _cells(self, prior: Prior, features: int) -> DataFrame:
        """The keys, v, and the features as columns z0, z1, ..., of the cells that are given; their coordinates must exist."""
        z = [F.col("x")[m].alias(f"z{m}") for m in range(features)]
        return inside(self.y.select(*prior.keys, "v", *z), self.graph)

    def _full(self, prior: Prior) -> DataFrame:
        """All cells."""
        cells = grid(self.graph)
        return cells.join(self.rows.select(F.col("t").cast("int").alias("t")), how="cross").select(*prior.keys) if self.rows is not None else cells

    def _predict(self, prior: Prior, solution: Solution, cells: DataFrame, side: int, classes: int) -> tuple[DataFrame, list[Column], list[Column]]:
        """All cells with the intercepts; columns of these and of f."""
        names = [f"_b{c}" for c in range(classes)]
        b = prior.apply(solution.cells.select(*prior.keys, *[F.col(f"a{side}_{c}").alias(n) for c, n in enumerate(names)]), names)
        whole = cells.join(b, prior.keys, "left").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})
        w = solution.weights[side]
        f = [_total([F.col(n), *(F.col(f"z{m}") * float(w[m, c]) for m in range(len(w)))]) for c, n in enumerate(names)]
        return whole, [F.col(n) for n in names], f

    def fit(self) -> Fitted:
        """Prediction v, intercept b and weights (m, w) of a Gaussian model, in the signal's units."""
        if self.link != "gaussian":
            raise ValueError("only Gaussian models have predictions in the signal's units")
        features, prior = self._features(), self.prior()
        stats = statistics(self.y).first()
        cells = self._cells(prior, features)
        seen = cells.where("v is not null").withColumn("y0", (F.col("v") - stats["loc"]) / stats["scale"])
        if self.solver == "splitting":
            solution = Solution(splitting(seen, prior), [np.zeros((0, 1))])
        else:
            solution = gaussian(seen, prior, features, self.lam or 0.0)
        everywhere = cells if features else self._full(prior)
        whole, b, f = self._predict(prior, solution, everywhere, 0, 1)
        units = lambda c: c * stats["scale"] + stats["loc"]
        weights = [(m, float(x) * stats["scale"]) for m, x in enumerate(solution.weights[0][:, 0])]
        spark = self.y.sparkSession
        return Fitted(whole.select(*prior.keys, units(f[0]).alias("v"), units(b[0]).alias("b")), spark.createDataFrame(weights, "m int, w double"))

    def solve(self, classify: bool = False) -> DataFrame:
        """v of all cells: the posterior mean, a probability, or a label; for softmax p, the array of probabilities, or a label.

        With features, of the cells that have them.
        """
        if self.link == "gaussian":
            return self.fit().cells if self.lam is not None else self.fit().cells.drop("b")
        features, prior, classes = self._features(), self.prior(), self.classes
        link = Logistic() if self.link == "logistic" else Softmax()
        cells = self._cells(prior, features)
        label = [F.col("v")] if classes == 1 else [(F.col("v") == c).cast("double") for c in range(classes)]
        wrong = cells.where((F.col("v") < 0) | (F.col("v") > max(1, classes - 1)) | (F.col("v") != F.round("v")))
        if wrong.limit(1).count():
            raise ValueError(f"labels must be whole numbers from 0 to {max(1, classes - 1)}")
        seen = cells.where("v is not null").select("*", *[x.alias(f"y{c}") for c, x in enumerate(label)])
        solution = newton(seen, prior, link, classes, features, self.lam or 0.0)
        whole, _, f = self._predict(prior, solution, cells if features else self._full(prior), 0, classes)
        mu = link.mean(f)
        if classes == 1:
            return whole.select(*prior.keys, ((f[0] > 0).cast("int") if classify else mu[0]).alias("v"))
        if classify:
            first = F.array_position(F.array(*f), F.greatest(*f)) - 1
            return whole.select(*prior.keys, first.cast("int").alias("v"))
        return whole.select(*prior.keys, F.array(*mu).alias("p"))

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        """``n`` posterior draws of a Gaussian model: sample, the keys, v.

        A draw of the prior and of the noise is corrected by the solution for what the data say against it; ``BLOCK``
        draws are solved together, by one conjugate gradient with a right-hand side for each.
        """
        if self.link != "gaussian" or self.lam == 0:
            raise ValueError("only Gaussian models whose weights have a penalty have draws")
        features, prior = self._features(), self.prior(draws=True)
        stats = statistics(self.y).first()
        cells = self._cells(prior, features)
        out = None
        for first in range(0, n, BLOCK):
            draws = list(range(first, min(n, first + BLOCK)))
            made = cut(prior.draw(seed, draws))
            rng = [np.random.default_rng([seed, d]).standard_normal((features, 1)) / math.sqrt(self.lam) if features else np.zeros((0, 1)) for d in draws]
            fixed = [_total([F.col(f"g{k}"), *(F.col(f"z{m}") * float(rng[k][m, 0]) for m in range(features))]) for k in range(len(draws))]
            seen = cells.where("v is not null").join(made, prior.keys)
            gaps = [(F.col("v") - stats["loc"]) / stats["scale"] - f - normal(seed, d, 1, *prior.keys) for f, d in zip(fixed, draws)]
            solution = gaussian(seen.select(*prior.keys, *[f"z{m}" for m in range(features)], *[g.alias(f"y{k}") for k, g in enumerate(gaps)]), prior, features, self.lam or 0.0, len(draws))
            names = [f"_b{k}" for k in range(len(draws))]
            b = prior.apply(solution.cells.select(*prior.keys, *[F.col(f"a{k}_0").alias(n_) for k, n_ in enumerate(names)]), names)
            whole = (made.join(cells.drop("v"), prior.keys) if features else made).join(b, prior.keys, "left")
            total = [_total([x, F.coalesce(F.col(n_), F.lit(0.0)), *(F.col(f"z{m}") * float(w[m, 0]) for m in range(features))]) for x, n_, w in zip(fixed, names, solution.weights)]
            rows = F.array(*[F.struct(F.lit(d).alias("sample"), (t * stats["scale"] + stats["loc"]).alias("v")) for d, t in zip(draws, total)])
            block = whole.select(*prior.keys, F.inline(rows)).select("sample", *prior.keys, "v")
            out = block if out is None else out.unionByName(block)
        return out

    def estimate_marginal_variance(self, n: int = 64, seed: int = 0) -> DataFrame:
        """variance of each cell, the mean square of ``n`` draws about the posterior mean, and error, its standard error.

        Draws are normal, so that the error is the root of 2 / n of the variance.
        """
        keys = [c for c in self.y.columns if c not in ("v", "x")]
        mean = cut(self.solve().select(*keys, F.col("v").alias("_mean")))
        square = F.avg(F.pow(F.col("v") - F.col("_mean"), F.lit(2)))
        sampled = self.sample(n, seed).join(mean, keys).groupBy(*keys).agg(square.alias("variance"))
        return sampled.withColumn("error", F.col("variance") * math.sqrt(2 / n))
