"""Sorts and top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """T1."""
    return df.orderBy(*keys)


def first_n(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int,
) -> DataFrame:
    """The first ``n`` rows of each group.

    Spark cuts each task's share of a group to ``n`` rows before the shuffle, so a large group
    arrives as at most ``n`` rows per task. ``order`` should end in a unique column.
    """
    spec = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(spec)).where(F.col("__rn") <= n).drop("__rn")


def top_n_per_group(
    df: DataFrame, by: str, key: str, n: int, tie: Sequence[str] = (),
) -> DataFrame:
    """The ``n`` smallest ``key`` of each group (T2), with equal keys ordered by ``tie``."""
    return first_n(df, [by], [F.col(key).asc_nulls_last(), *tie], n)


def best_row(df: DataFrame, key: str, tie: Sequence[str] = ()) -> DataFrame:
    """The row with the smallest ``key``."""
    return df.orderBy(F.col(key).asc_nulls_last(), *tie).limit(1)
