"""Profiles, counts, pivots and correlations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations_with_replacement
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """A1."""
    return df.select(*columns).distinct()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first (A2)."""
    return df.groupBy(column).count().orderBy(F.desc("count"), F.col(column))


def _unpivot(df: DataFrame, values: dict[str, list]) -> DataFrame:
    """One row per entry of the aggregated one-row frame: ``values`` maps outputs to columns."""
    length = len(next(iter(values.values())))
    rows = F.array(*[F.struct(*[cols[i].alias(name) for name, cols in values.items()])
                     for i in range(length)])
    return df.select(F.explode(rows).alias("r")).select("r.*")


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, all columns in one pass (A3)."""
    counted = df.agg(*[
        F.count(F.when(F.col(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(df.columns)
    ])
    return _unpivot(counted, {
        "column_name": [F.lit(c) for c in df.columns],
        "n_missing": [F.col(f"n{i}") for i in range(len(df.columns))],
    })


def profile(df: DataFrame) -> DataFrame:
    """Type, rows and present values per column, all columns in one pass (A4)."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)
    ])
    return _unpivot(counted, {
        "column_name": [F.lit(c) for c in df.columns],
        "data_type": [F.lit(t) for _, t in df.dtypes],
        "n_rows": [F.col("rows") for _ in df.columns],
        "n_present": [F.col(f"n{i}") for i in range(len(df.columns))],
    })


def retention(raw: DataFrame, kept: DataFrame, by: str = "ticker") -> DataFrame:
    """Rows before and after a filter and the share kept, by group."""
    before = raw.groupBy(by).agg(F.count(F.lit(1)).alias("n_raw"))
    after = kept.groupBy(by).agg(F.count(F.lit(1)).alias("n_kept"))
    n_kept = F.coalesce("n_kept", F.lit(0).cast("bigint"))
    return before.join(after, by, "left").select(
        by, "n_raw", n_kept.alias("n_kept"), (n_kept / F.col("n_raw")).alias("retention_rate")
    )


def pivot_metric(
    df: DataFrame, metric: str, tickers: Sequence[Any] | None = None, row: str = "date",
    column: str = "ticker",
) -> DataFrame:
    """One row per date and one column per ticker (A12); a repeated key is an error.

    Known ``tickers`` spare the pass that looks them up.
    """
    single = df.groupBy(row, column).agg(
        F.first(metric).alias("__value"), F.count(F.lit(1)).alias("__n")
    ).withColumn(
        "__value",
        F.when(F.col("__n") == 1, F.col("__value")).otherwise(
            F.raise_error(F.lit(f"{row}, {column} repeats")).cast("double")
        ),
    )
    grouped = single.groupBy(row)
    pivoted = grouped.pivot(column, list(tickers)) if tickers is not None else grouped.pivot(column)
    return pivoted.agg(F.first("__value", ignorenulls=True))


def _correlation(a: Column, b: Column) -> Column:
    """Pearson correlation; NaN where a column has one value only, NULL without a pair.

    One value is told by least and greatest: merged moments of equal values may differ from 0 by rounding.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    deviations = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(flat, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(x, y), deviations))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over complete pairs (A13), in one pass."""
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    summary = df.agg(*[
        _correlation(F.col(columns[i]), F.col(columns[j])).alias(f"c{i}_{j}") for i, j in pairs
    ])
    cells = [(i, j) for i in range(len(columns)) for j in range(len(columns))]
    return _unpivot(summary, {
        "column_a": [F.lit(columns[i]) for i, _ in cells],
        "column_b": [F.lit(columns[j]) for _, j in cells],
        "correlation": [F.col(f"c{min(c)}_{max(c)}") for c in cells],
    })
