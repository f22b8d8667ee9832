"""Spectral filters: functions of graph frequencies, as Spark column expressions and as numpy functions.

A filter is immutable. A univariate filter has one parameter and works on the total frequency of a node of
the spectrum; a multivariate filter has one parameter for each graph axis. All built-in filters are 1 at
frequency 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Numpy:
    """The functions that filters are written with, for arrays."""

    exp = staticmethod(np.exp)
    max0 = staticmethod(lambda x: np.maximum(x, 0.0))
    flag = staticmethod(lambda c: np.asarray(c, float))
    both = staticmethod(np.logical_and)


class _Spark:
    """The same functions for columns."""

    exp = staticmethod(F.exp)
    max0 = staticmethod(lambda x: F.greatest(x, F.lit(0.0)))
    flag = staticmethod(lambda c: c.cast("double"))
    both = staticmethod(lambda a, b: a & b)


@dataclass(frozen=True)
class Filter:
    """A named gain function ``shape(functions, s)`` of s, the weighted sum of the frequencies.

    ``separable`` says that the gain of a sum is the product of the gains; ``custom`` replaces ``shape`` by a
    function of the frequencies and the parameters, which must work on columns and arrays alike.
    """

    name: str
    beta: tuple[float, ...]
    multivariate: bool
    shape: Callable | None = None
    custom: Callable | None = None
    separable: bool = False

    def __post_init__(self) -> None:
        if not self.beta or any(b < 0 for b in self.beta):
            raise ValueError("filter parameters must not be negative")
        if not self.multivariate and len(self.beta) != 1:
            raise ValueError("a univariate filter has one parameter")

    @property
    def ndim(self) -> int | None:
        """The number of graph axes that a multivariate filter is made for."""
        return len(self.beta) if self.multivariate else None

    def with_beta(self, *beta: float) -> Filter:
        """A filter of the same kind with other parameters, as many as before."""
        if len(beta) != len(self.beta):
            raise ValueError(f"{len(self.beta)} parameters expected")
        return replace(self, beta=tuple(map(float, beta)))

    def _gain(self, m: type, lams: Sequence):
        if self.multivariate and len(lams) != len(self.beta):
            raise ValueError(f"the filter is made for {len(self.beta)} axes, the graph has {len(lams)}")
        total = lams[0]
        for x in lams[1:]:
            total = total + x
        if self.custom:
            return self.custom(*lams, self.beta) if self.multivariate else self.custom(total, self.beta[0])
        if self.name == "bandlimited":
            if not self.multivariate:
                b = self.beta[0]
                return m.flag(total <= 1 / b) if b else m.flag(total >= 0)
            keep = lams[0] * self.beta[0] < 1
            for x, b in zip(lams[1:], self.beta[1:]):
                keep = m.both(keep, x * b < 1)
            return m.flag(keep)
        if self.multivariate:
            s = lams[0] * self.beta[0]
            for x, b in zip(lams[1:], self.beta[1:]):
                s = s + x * b
        else:
            s = total * self.beta[0]
        return self.shape(m, s)

    def column(self, *lams: Column) -> Column:
        """The gain as a column of one frequency column for each axis."""
        return self._gain(_Spark, lams)

    def array(self, *lams: np.ndarray) -> np.ndarray:
        """The gain as an array of one frequency array for each axis."""
        return np.asarray(self._gain(_Numpy, [np.asarray(x, float) for x in lams]), float)


_SHAPES: dict[str, Callable] = {
    "random_walk": lambda m, s: 1 / (1 + s),
    "diffusion": lambda m, s: m.exp(-s),
    "relu": lambda m, s: m.max0(1 - s),
    "sigmoid": lambda m, s: 2 * m.exp(-s) / (1 + m.exp(-s)),
    "bandlimited": None,
}
NAMES = tuple(_SHAPES)


def univariate(name: str, beta: float) -> Filter:
    """One of ``NAMES`` on the total frequency."""
    return Filter(name, (float(beta),), False, _SHAPES[name], separable=name == "diffusion")


def multivariate(name: str, *beta: float) -> Filter:
    """One of ``NAMES`` with a parameter for each axis."""
    return Filter(name, tuple(map(float, beta)), True, _SHAPES[name], separable=name in ("diffusion", "bandlimited"))


def custom(function: Callable, *beta: float, axes: bool = False) -> Filter:
    """A filter from a function (frequency, beta), or with ``axes`` (frequency 1, ..., all betas)."""
    return Filter("custom", tuple(map(float, beta)), axes, custom=function)
