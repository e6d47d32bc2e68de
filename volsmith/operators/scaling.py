"""Standard scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volsmith.session import stage


def fit_scaler(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of columns, one row per group."""
    measures = []
    for c in columns:
        measures += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return df.groupBy(*by).agg(*measures)


def _scale(column: str) -> Column:
    deviation = F.col(f"{column}__std")
    return F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)


def _with_stats(df: DataFrame, stats: DataFrame, by: Sequence[str], columns: Sequence[str]):
    wanted = [f"{c}__{part}" for c in columns for part in ("mean", "std")]
    if by:
        return df.join(stats.select(*by, *wanted), list(by), "left")
    only = stats.select(*wanted).first()
    return df.withColumns({c: F.lit(only[c]).cast("double") for c in wanted})


def standardise(
    df: DataFrame, columns: Sequence[str], stats: DataFrame | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Columns replaced by (x - mean) / deviation (X5); a constant column becomes 0.

    ``stats`` from ``fit_scaler`` on other rows (training rows, say) avoids looking ahead.
    """
    if stats is None:
        stats = stage(fit_scaler(df, columns, by), "scaler")
    scaled = {c: (F.col(c) - F.col(f"{c}__mean")) / _scale(c) for c in columns}
    return _with_stats(df, stats, by, columns).withColumns(scaled).select(*df.columns)


def unscale(
    df: DataFrame, column: str, stats: DataFrame, source: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Scores turned back into units (X5); ``source`` names the column the stats belong to."""
    source = source or column
    restored = F.col(column) * _scale(source) + F.col(f"{source}__mean")
    return _with_stats(df, stats, by, [source]).withColumn(column, restored).select(*df.columns)
