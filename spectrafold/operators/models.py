"""Reconstruction and regression models of graph signals.

Each model takes a signal table (axis columns, ``v`` with NULL for missing cells, and any number of
problem columns ``by``: each combination of their values is a problem of its own). Problems are solved in
parallel, one Arrow group each, by the array solvers; the bases and gains of the graph go to the tasks with
the function. A problem must fit one task: models refuse graphs of more than ``CELLS`` cells, for which
``tables.TableModel`` solves the same with joins and aggregations (``on_tables`` gives it for a model).

Kernel models have a leading axis ``t`` whose rows have covariates; cohesion models have features ``x``
(array of doubles, no nulls) in each cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import Filter
from ..plans.lineage import cut
from ..sources.signals import require_double
from . import dense
from .graphs import DENSE_NODES, AnyGraph, axes
from .transform import gain_array

CELLS = 5_000_000


@dataclass(frozen=True)
class Model:
    """What all models share. ``y``: the signal; ``by``: problem columns."""

    y: DataFrame
    graph: AnyGraph
    filter: Filter
    gamma: float
    by: tuple[str, ...] = ()

    normalised = True

    def __post_init__(self) -> None:
        if self.gamma <= 0:
            raise ValueError("gamma must be positive")
        missing = {*self.axes, "v", *self.by} - set(self.y.columns)
        if missing:
            raise ValueError(f"the signal lacks columns {sorted(missing)}")
        require_double(self.y, "v", *(["x"] if "x" in self.y.columns else []))
        if int(np.prod(self.shape)) > CELLS:
            raise ValueError(f"more than {CELLS} cells; use tables.TableModel")
        if max(self.graph.shape) > DENSE_NODES:
            raise ValueError(f"an axis of more than {DENSE_NODES} nodes; use tables.TableModel")

    def with_gamma(self, gamma: float) -> Model:
        return replace(self, gamma=gamma)

    def on_tables(self):
        """The same model over tables, for one problem of any size."""
        from .tables import TableModel

        if self.by:
            raise ValueError("models over tables have one problem")
        link = "softmax" if isinstance(self, _Multiclass) else "logistic" if isinstance(self, _Logistic) else "gaussian"
        covariates, rows = getattr(self, "covariates", None), None
        if covariates is not None:
            rows = self.y.sparkSession.createDataFrame([(t, x) for t, x in enumerate(np.asarray(covariates, float).tolist())], "t int, x array<double>")
        return TableModel(
            self.y, self.graph, self.filter, self.gamma, lam=getattr(self, "lam", None), rows=rows, kernel_std=getattr(self, "kernel_std", 1.0), link=link, classes=self.classes if link == "softmax" else 1
        )

    def with_beta(self, *beta: float) -> Model:
        return replace(self, filter=self.filter.with_beta(*beta))

    @property
    def axes(self) -> list[str]:
        return axes(self.graph)

    @property
    def shape(self) -> tuple[int, ...]:
        return self.graph.shape

    def prior(self) -> dense.Prior:
        return dense.Prior(tuple(f.u for f in self.graph.factors), gain_array(self.graph, self.filter))

    def _run(self, solve: Callable, outputs: str = "v double", cells: bool = True, seed: int | None = None) -> DataFrame:
        """Scatter each problem to arrays, solve, and give rows again.

        ``solve`` takes (observed values with 0 for missing ones, mask, features or None, prior, location, scale,
        and with a seed a random generator of the problem's own) and returns an array with the outputs on its last
        axis.
        """
        shape, names, by, prior, normalised = self.shape, self.axes, list(self.by), self.prior(), self.normalised
        columns = [c.split()[0] for c in outputs.split(", ")]
        one = not by
        signal = self.y.withColumn("_one", F.lit(0)) if one else self.y
        keys = ["_one"] if one else by
        if seed is not None:
            signal, keys = signal.withColumn("_seed", F.xxhash64(F.lit(seed), *by)), ["_seed", *keys]
        has_x = "x" in signal.columns

        def problem(frame: pd.DataFrame) -> pd.DataFrame:
            at = tuple(frame[a].to_numpy(int) for a in names)
            v = frame["v"].to_numpy(float)
            y, s = np.zeros(shape), np.zeros(shape)
            seen = ~np.isnan(v)
            inside = tuple(a[seen] for a in at)
            loc = scale = None
            if normalised:
                loc = v[seen].mean() if seen.any() else 0.0
                scale = (v[seen].std() if seen.any() else 1.0) or 1.0
                y[inside] = (v[seen] - loc) / scale
            else:
                y[inside] = v[seen]
            s[inside] = 1.0
            x = None
            if has_x:
                features = np.array(frame["x"].tolist(), float)
                if np.isnan(features).any() or len(frame) < s.size:
                    raise ValueError("every cell needs features without nulls")
                x = np.zeros((*shape, features.shape[1]))
                x[at] = features
            drawn = () if seed is None else (np.random.default_rng(int(frame["_seed"].iloc[0]) & (1 << 63) - 1),)
            out = solve(y, s, x, prior, loc, scale, *drawn)
            if cells:
                grid = np.indices(shape).reshape(len(shape), -1)
                table = {n: g.astype(np.int32) for n, g in zip(names, grid)}
                table |= dict(zip(columns, out.reshape(-1, len(columns)).T))
            else:
                table = dict(zip(columns, np.asarray(out).T))
            result = pd.DataFrame(table)
            for k in keys:
                result.insert(0, k, frame[k].iloc[0])
            return result

        kinds = {f.name: f.dataType.simpleString() for f in signal.schema.fields}
        schema = ", ".join([f"`{k}` {kinds[k]}" for k in reversed(keys)] + ([f"{a} int" for a in names] if cells else []) + [outputs])
        out = signal.select(*keys, *names, "v", *(["x"] if has_x else [])).groupBy(*keys).applyInPandas(problem, schema)
        return out.drop("_one", "_seed")

    # ---- Gaussian models: subclasses give _mean and _draw in normalised units ----------------------------

    def solve(self) -> DataFrame:
        """The posterior mean of every cell."""
        gamma, lam, mean = self.gamma, getattr(self, "lam", None), type(self)._mean
        return self._run(lambda y, s, x, prior, loc, scale: mean(y, s, x, prior, gamma, lam) * scale + loc)

    def sample(self, n: int, seed: int = 0, first: int = 0) -> DataFrame:
        """``n`` posterior draws: sample, the cells, v. Draws are spread over tasks, each with a seed of its own."""
        spread = self.y.withColumn("sample", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))
        gamma, lam, draw = self.gamma, getattr(self, "lam", None), type(self)._draw
        model = replace(self, y=spread, by=(*self.by, "sample"))
        return model._run(lambda y, s, x, prior, loc, scale, rng: draw(y, s, x, prior, gamma, lam, rng) * scale + loc, seed=seed)

    def generate_samples(self, n: int, seed: int = 0) -> Iterator[DataFrame]:
        """The draws of ``sample`` one by one, each computed when it is used."""
        for i in range(n):
            yield self.sample(1, seed, i)

    def estimate_marginal_variance(self, n: int = 100, seed: int = 0) -> DataFrame:
        """The mean squared distance of draws from the posterior mean, in each cell."""
        keys = [*self.by, *self.axes]
        mean = self.solve().withColumnRenamed("v", "_mean")
        gap = F.pow(F.col("v") - F.col("_mean"), F.lit(2))
        return self.sample(n, seed).join(mean, keys).groupBy(*keys).agg(F.avg(gap).alias("variance"))

    def marginal_variance(self) -> DataFrame:
        """The exact posterior variance of each cell of a Gaussian model, for small graphs."""
        if not self.normalised:
            raise NotImplementedError("this model has no Gaussian posterior")
        gamma, lam = self.gamma, getattr(self, "lam", None)
        return self._run(lambda y, s, x, prior, loc, scale: dense.marginal_variance(s, prior, gamma, x if lam is not None else None, lam) * scale**2, "variance double")

    @staticmethod
    def _mean(y, s, x, prior, gamma, lam):
        raise NotImplementedError("this model has no Gaussian posterior")

    @staticmethod
    def _draw(y, s, x, prior, gamma, lam, rng):
        raise NotImplementedError("this model has no Gaussian posterior")


@dataclass(frozen=True)
class GSR(Model):
    """Graph signal reconstruction."""

    @staticmethod
    def _mean(y, s, x, prior, gamma, lam):
        return dense.gsr(y, s, prior, gamma)

    @staticmethod
    def _draw(y, s, x, prior, gamma, lam, rng):
        return dense.sample_gsr(y, s, prior, gamma, rng)


class _Kernel:
    """A leading axis ``t`` with covariates; their kernel is decomposed in the driver, so that they are bounded."""

    def __post_init__(self) -> None:
        if not 0 < len(self.covariates if self.covariates is not None else ()) <= DENSE_NODES:
            raise ValueError(f"covariates of 1 to {DENSE_NODES} rows are expected")
        super().__post_init__()

    @property
    def axes(self) -> list[str]:
        return ["t", *axes(self.graph)]

    @property
    def shape(self) -> tuple[int, ...]:
        return (len(self.covariates), *self.graph.shape)

    def prior(self) -> dense.Prior:
        lam, v = np.linalg.eigh(dense.rbf_kernel(np.asarray(self.covariates, float), self.kernel_std))
        return super().prior().with_kernel(v, lam)


@dataclass(frozen=True)
class KGR(_Kernel, GSR):
    """Kernel graph regression: ``covariates`` is an array with a row for each t; cells have t, ax0, ..."""

    covariates: np.ndarray = field(default=None, compare=False)
    kernel_std: float = 1.0


class _Cohesion:
    """Features in each cell and a ridge penalty ``lam`` on their weights."""

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.lam < 0:
            raise ValueError("lam must not be negative")
        if "x" not in self.y.columns:
            raise ValueError("the signal lacks the features x")

    def with_lam(self, lam: float):
        return replace(self, lam=lam)


@dataclass(frozen=True)
class RNC(_Cohesion, Model):
    """Regression with network cohesion: an intercept for each cell and weights of the features."""

    lam: float = 1.0

    @staticmethod
    def _mean(y, s, x, prior, gamma, lam):
        b, w = dense.solve_rnc(y, s, x, prior, gamma, lam)
        return b + x @ w

    @staticmethod
    def _draw(y, s, x, prior, gamma, lam, rng):
        b, w = dense.sample_rnc(y, s, x, prior, gamma, lam, rng)
        return b + x @ w

    def solve(self) -> DataFrame:
        """v, the prediction, and b, its intercept, both in the signal's units."""
        gamma, lam = self.gamma, self.lam

        def run(y, s, x, prior, loc, scale):
            b, w = dense.solve_rnc(y, s, x, prior, gamma, lam)
            return np.stack([(b + x @ w) * scale + loc, b * scale + loc], -1)

        return self._run(run, "v double, b double")

    def fit(self) -> Fitted:
        """Prediction, intercepts and weights of one solution."""
        gamma, lam = self.gamma, self.lam

        def run(y, s, x, prior, loc, scale):
            b, w = dense.solve_rnc(y, s, x, prior, gamma, lam)
            cells = np.stack([(b + x @ w) * scale + loc, b * scale + loc], -1).reshape(-1, 2).astype(object)
            carried = np.full((len(cells), 1), None, object)
            carried[0, 0] = (w * scale).tolist()  # the weights of a problem come with its first cell
            return np.concatenate([cells, carried], 1)

        out = cut(self._run(run, "v double, b double, w array<double>"))
        return Fitted(out.drop("w"), out.where("w is not null").select(*self.by, F.posexplode("w").alias("m", "w")))

    def weights(self) -> DataFrame:
        """m, w: the weight of each feature in the signal's units."""
        return self.fit().weights


@dataclass(frozen=True)
class Fitted:
    """A solved regression: cells (the axes, v, b) and weights (m, w), both in the signal's units."""

    cells: DataFrame
    weights: DataFrame

    def predictor(self, features: DataFrame) -> DataFrame:
        """F = b + X w of each cell, with the features x of a table with the same axis columns."""
        by = [c for c in self.weights.columns if c not in ("m", "w")]
        keys = [c for c in self.cells.columns if c not in ("v", "b")]
        listed = self.weights.groupBy(*by) if by else self.weights.groupBy()
        ordered = listed.agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "w"))), lambda p: p["w"]).alias("w"))
        cells = self.cells.join(features.select(*keys, "x"), keys)
        both = cells.join(ordered, by) if by else cells.join(F.broadcast(ordered), how="cross")  # one row of weights
        dot = F.aggregate(F.zip_with("x", "w", lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
        return both.select(*keys, (F.col("b") + dot).alias("f"))


@dataclass(frozen=True)
class KGRNC(_Kernel, RNC):
    """Regression with network cohesion on a kernel axis and a graph."""

    covariates: np.ndarray = field(default=None, compare=False)
    kernel_std: float = 1.0


class _Logistic:
    """Labels 0 and 1; solve gives probabilities, or labels with ``classify``."""

    normalised = False

    def solve(self, classify: bool = False) -> DataFrame:
        gamma, lam, total = self.gamma, getattr(self, "lam", None), type(self)._total

        def run(y, s, x, prior, loc, scale):
            f = total(y, s, x, prior, gamma, lam)
            return (f > 0).astype(float) if classify else dense.mu_logistic(f)

        out = self._run(run)
        return out.withColumn("v", F.col("v").cast("int")) if classify else out


@dataclass(frozen=True)
class LGSR(_Logistic, Model):
    """Logistic graph signal reconstruction."""

    @staticmethod
    def _total(y, s, x, prior, gamma, lam):
        return dense.lgsr(y, s, prior, gamma)


@dataclass(frozen=True)
class LKGR(_Kernel, LGSR):
    """Logistic kernel graph regression."""

    covariates: np.ndarray = field(default=None, compare=False)
    kernel_std: float = 1.0


@dataclass(frozen=True)
class LRNC(_Cohesion, _Logistic, Model):
    """Logistic regression with network cohesion."""

    lam: float = 1.0

    @staticmethod
    def _total(y, s, x, prior, gamma, lam):
        b, w = dense.lrnc(y, s, x, prior, gamma, lam)
        return b + x @ w


class _Multiclass:
    """Labels 0, 1, ..., classes - 1; solve gives a column p of class probabilities, or labels."""

    normalised = False

    def solve(self, classify: bool = False) -> DataFrame:
        gamma, lam, total, classes = self.gamma, getattr(self, "lam", None), type(self)._total, self.classes

        def run(y, s, x, prior, loc, scale):
            if (s * (y - np.round(y))).any() or y.min() < 0 or y.max() >= classes:
                raise ValueError(f"labels must be whole numbers from 0 to {classes - 1}")
            hot = np.eye(classes)[y.astype(int)] * s[..., None]
            f = total(hot, s, x, prior, gamma, lam)
            return f.argmax(-1).astype(float) if classify else dense.mu_softmax(f)

        if classify:
            return self._run(run).withColumn("v", F.col("v").cast("int"))
        names = [f"p{c}" for c in range(classes)]
        out = self._run(run, ", ".join(f"{n} double" for n in names))
        return out.withColumn("p", F.array(*names)).drop(*names)


@dataclass(frozen=True)
class MulticlassLGSR(_Multiclass, Model):
    """Softmax graph signal reconstruction."""

    classes: int = 2

    @staticmethod
    def _total(y, s, x, prior, gamma, lam):
        return dense.lgsr_multiclass(y, s, prior, gamma)


@dataclass(frozen=True)
class MulticlassLKGR(_Kernel, MulticlassLGSR):
    """Softmax kernel graph regression."""

    covariates: np.ndarray = field(default=None, compare=False)
    kernel_std: float = 1.0


@dataclass(frozen=True)
class MulticlassLRNC(_Cohesion, _Multiclass, Model):
    """Softmax regression with network cohesion."""

    classes: int = 2
    lam: float = 1.0

    @staticmethod
    def _total(y, s, x, prior, gamma, lam):
        b, w = dense.lrnc_multiclass(y, s, x, prior, gamma, lam)
        return b + x @ w


def kernel_pairs(rows: DataFrame, std: float, key: str = "t", x: str = "x") -> DataFrame:
    """a, b, k: the RBF kernel of all pairs of rows (an array column x), as a join of the rows with themselves."""
    other = rows.select(F.col(key).alias("b"), F.col(x).alias("_y"))
    square = F.aggregate(F.zip_with(x, "_y", lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda a, b: a + b)
    return rows.select(F.col(key).alias("a"), x).join(other, how="cross").select("a", "b", F.exp(-square / (2 * std * std)).alias("k"))

