"""Array expressions on forecasting windows (Q2-Q4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from volsmith.config import EWMA_ALPHA


def window_feature(x: str | Column, position: int) -> Column:
    """One feature of every step of a window (steps x features)."""
    return F.transform(F.col(x) if isinstance(x, str) else x, lambda step: step[position])


def leading_feature(x: str | Column) -> Column:
    """The first feature of every step of a window."""
    return window_feature(x, 0)


def ewma(series: str | Column, alpha: float = EWMA_ALPHA) -> Column:
    """Exponentially weighted mean of an array, started at its first element."""
    values = F.col(series) if isinstance(series, str) else series
    return F.aggregate(
        F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))),
        F.get(values, F.lit(0)),
        lambda state, value: F.lit(alpha) * value + F.lit(1 - alpha) * state,
    )


def array_mean(values: str | Column) -> Column:
    array = F.col(values) if isinstance(values, str) else values
    return F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v) / F.size(array)


def target(y: str = "y", use_mean: bool = False) -> Column:
    """One number to forecast: the mean over the horizon or its first step (Q3)."""
    return array_mean(y) if use_mean else F.col(y)[0]


def flat_window(x: str = "x") -> Column:
    """Window flattened to steps*features numbers, step by step (Q4)."""
    return F.flatten(F.col(x))
