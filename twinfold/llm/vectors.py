"""What vector operators share: which vectors take part, and exact cosines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    whole = vector.cast("array<double>")
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(whole, lambda x: x != 0), F.lit(False))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square overflows or vanishes and no digit changes."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each pair of rows, added up from the first component to the last."""
    return np.cumsum(a * b, axis=1)[:, -1]


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    scaled = _scaled(rows)
    return scaled / np.sqrt(_dot(scaled, scaled))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision; the same for equal pairs wherever they stand."""
    a, b = _scaled(a), _scaled(b)
    return _dot(a, b) / np.sqrt(_dot(a, a) * _dot(b, b))
