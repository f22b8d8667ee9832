"""Reconstruction of signals too large for one task, by conjugate gradients over tables.

The system is solved on the observed cells: with K = H^2, (K + gamma I) a = y there and f = K a everywhere.
The state of the iteration is one row for each observed cell. A step applies K once, by one join and sum
for each axis where the filter is a product over the axes and by two transforms elsewhere, or by a
polynomial on graphs too large for basis tables. The two inner products that a step needs are taken while
the state is written to the checkpoint folder, so that a step is one job, plans stay short, and lost
executors cost one step. The kernels are written once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.filters import Filter
from ..plans.lineage import cut
from .dense import NotConverged
from .graphs import AnyGraph, axes, inside
from .transform import apply_kernels, beyond_bases, filter_signal, kernels


def smoother(graph: AnyGraph, g: Filter) -> Callable[[DataFrame], DataFrame]:
    """H^2 as a function of signals, with its kernels written to the checkpoint folder if it has some."""
    matrices = None if beyond_bases(graph) else kernels(graph, g, 2.0)
    if matrices is None:
        return lambda signal: filter_signal(signal, graph, g, 2.0)
    held = [(axis, cut(kernel), rows) for axis, kernel, rows in matrices]
    return lambda signal: apply_kernels(signal, held)


def reconstruct(y: DataFrame, graph: AnyGraph, g: Filter, gamma: float, tol: float = 1e-8, max_iter: int = 200) -> DataFrame:
    """The posterior mean (not normalised) of a signal with NULL for missing cells: ax0, ..., v.

    Conjugate gradients with one reduction in each step: the step lengths come from (r, r) and (r, A r) alone.
    """
    keys = axes(graph)
    smooth = smoother(graph, g)
    seen = inside(y.where("v is not null").select(*keys, F.col("v").cast("double").alias("v")), graph)

    def written(state: DataFrame) -> tuple[DataFrame, float, float]:
        """state with w = A r, cut, and (r, r) and (r, w)."""
        ar = smooth(state.select(*keys, F.col("r").alias("v"))).withColumnRenamed("v", "_k")
        sums = Observation()
        whole = state.join(ar, keys).withColumn("w", F.col("_k") + gamma * F.col("r")).drop("_k")
        out = cut(whole.observe(sums, F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.col("w")).alias("rw")))
        found = sums.get
        return out, found["rr"] or 0.0, found["rw"] or 0.0

    zero = F.lit(0.0)
    state, rr, rw = written(seen.select(*keys, zero.alias("a"), F.col("v").alias("r"), zero.alias("p"), zero.alias("s")))
    start, alpha, beta = rr, rr / rw if rw else 0.0, 0.0
    for _ in range(max_iter):
        if rr <= tol * tol * start:
            return smooth(state.select(*keys, F.col("a").alias("v")))
        p, s = F.col("r") + beta * F.col("p"), F.col("w") + beta * F.col("s")
        moved = state.select(*keys, (F.col("a") + alpha * p).alias("a"), (F.col("r") - alpha * s).alias("r"), p.alias("p"), s.alias("s"))
        before = rr
        state, rr, rw = written(moved)
        beta = rr / before
        alpha = rr / (rw - beta * rr / alpha) if rr else 0.0
    raise NotConverged(f"no solution after {max_iter} steps")
