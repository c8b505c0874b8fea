"""Vectors of integers, floor(scale * x) a component, as the vector compression and the clustering use them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Larger components are held at this bound, so that squared distances of up to 128 of them fit 64 bits.
BOUND = 1 << 27


def finite(v: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor numbers that aren't finite."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(v: Column, scale: int) -> Column:
    """floor(scale * x) of each component of an array<double>; floors go down."""
    return F.transform(v, lambda x: F.floor(F.least(F.greatest(x * float(scale), F.lit(-float(BOUND))), F.lit(float(BOUND)))).cast("int"))


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column whose lists have ``dims`` integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis."""
    d = a - b
    return (d * d).sum(-1)


def summed_by(own: np.ndarray, x: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of the rows of x by their group, in whole numbers."""
    counts, sums = np.bincount(own, minlength=groups), np.zeros((groups, x.shape[1]), np.int64)
    if len(x):
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(own[order]) != 0))
        sums[own[order][starts]] = np.add.reduceat(x[order], starts, axis=0)
    return counts, sums
