"""Choice of a physical plan for reconstruction, and rewriting of filters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import Filter, multivariate, univariate
from ..operators import distributed
from ..operators.graphs import DENSE_NODES, AnyGraph
from ..operators.models import CELLS, GSR
from ..operators.transform import beyond_bases, chebyshev, scale_spectral


def closed_form(y: DataFrame, graph: AnyGraph, g: Filter, gamma: float) -> DataFrame:
    """The reconstruction of a fully observed signal: one filter, g^2 / (g^2 + gamma), one Catalyst plan."""
    gain = g.column(*[F.col(f"lam{a}") for a in range(graph.ndim)])
    if beyond_bases(graph) and not g.multivariate:
        return chebyshev(y, graph, Filter("custom", (1.0,), False, custom=lambda lam, _: shrinkage(_gain(g, lam), gamma)))
    return scale_spectral(y, graph, shrinkage(gain, gamma))


def shrinkage(gain: Column, gamma: float) -> Column:
    return gain * gain / (gain * gain + gamma)


def choose(graph: AnyGraph, fully_observed: bool) -> str:
    """filter (all observed), task (a problem and the bases of its axes fit one task) or tables (they don't)."""
    if fully_observed:
        return "filter"
    return "task" if math.prod(graph.shape) <= CELLS and max(graph.shape) <= DENSE_NODES else "tables"


def reconstruct(y: DataFrame, graph: AnyGraph, g: Filter, gamma: float) -> DataFrame:
    """The posterior mean of a signal in its own units, by the plan that suits it."""
    from ..sources.signals import postprocess, preprocess, statistics

    missing = y.where("v is null").limit(1).count() > 0 or y.count() < math.prod(graph.shape)
    plan = choose(graph, not missing)
    if plan == "task":
        return GSR(y, graph, g, gamma).solve()
    stats = F.broadcast(statistics(y))  # one row
    if plan == "filter":
        out = closed_form(preprocess(y).drop("obs", "loc", "scale"), graph, g, gamma)
    else:
        normal = y.join(stats, how="cross").withColumn("v", (F.col("v") - F.col("loc")) / F.col("scale")).drop("loc", "scale")
        out = distributed.reconstruct(normal, graph, g, gamma)
    return postprocess(out.join(stats, how="cross"))


def fuse(one: Filter, other: Filter) -> Filter:
    """One filter for two that are applied one after the other; diffusions add their parameters."""
    if one.name == other.name == "diffusion" and one.multivariate == other.multivariate:
        make = multivariate if one.multivariate else univariate
        return make("diffusion", *np.add(one.beta, other.beta).tolist())
    if one.multivariate != other.multivariate:
        raise ValueError("filters of different kinds aren't fused")
    if one.multivariate:
        return _product(one, other)
    return Filter("custom", (1.0,), False, custom=lambda lam, _: _gain(one, lam) * _gain(other, lam))


def _product(one: Filter, other: Filter) -> Filter:
    return Filter("custom", one.beta, True, custom=lambda *args: _gain(one, *args[:-1]) * _gain(other, *args[:-1]))


def _gain(g: Filter, *lams):
    return g.column(*lams) if isinstance(lams[0], Column) else g.array(*lams)


def decomposable(graph: AnyGraph) -> bool:
    """Whether every factor has a basis table; others need polynomial filters."""
    return all(f.kind in ("chain", "loop", "complete") or f.n <= DENSE_NODES for f in graph.factors)
