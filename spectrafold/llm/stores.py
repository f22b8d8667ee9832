"""Stores of words that tasks of one Python worker share, one store at a time.

Spark uses its workers again, so that the stores of all operators of a pipeline would be held together, whichever runs.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_held: dict[Hashable, Any] = {}


def shared(key: Hashable, make: Callable[[], Any]) -> Any:
    """The store with this key, made if it isn't there; the store of another operator goes first."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Let go of the store that is held, and give the memory back that it and the texts of earlier tasks took."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)
