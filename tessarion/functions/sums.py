"""Sums that keep what rounding loses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column


def two_sum(a: Column, b: Column) -> tuple[Column, Column]:
    """(the rounded sum of two doubles, what rounding it lost): together they are the sum exactly."""
    total = a + b
    added = total - a
    return total, (a - (total - added)) + (b - added)


def running(x: np.ndarray) -> np.ndarray:
    """Running sums along the last axis, each within a rounding or two of the true one: what every addition loses is summed up beside."""
    total = np.cumsum(x, axis=-1)
    before = np.concatenate([np.zeros((*x.shape[:-1], 1)), total[..., :-1]], axis=-1)
    added = total - before
    lost = (before - (total - added)) + (x - added)
    return total + np.cumsum(lost, axis=-1)

