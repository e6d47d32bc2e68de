"""The numbers behind the charts (C1-C6); drawing is left to the caller."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volsmith.operators.quantiles import exact_quantiles
from volsmith.session import stage


def _ranges(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    limits = []
    for c in columns:
        limits += [F.min(c).cast("double").alias(f"{c}__lo"),
                   F.max(c).cast("double").alias(f"{c}__hi")]
    return stage(df.groupBy(*by).agg(*limits), "ranges")


def _join_ranges(df: DataFrame, ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return df.join(ranges, list(by))
    only = ranges.first()
    return df.withColumns({c: F.lit(only[c]).cast("double") for c in ranges.columns})


def _bin(column: str, bins: int, single: int) -> Column:
    """Equal-width bin from 0; the maximum falls into the last one, a column's only value into ``single``."""
    low, high = F.col(f"{column}__lo"), F.col(f"{column}__hi")
    place = F.floor((F.col(column) - low) / (high - low) * bins)
    inner = F.when(place >= bins, F.lit(bins - 1)).otherwise(place)
    flat = F.col(column).isNotNull() & (high == low)
    return F.when(flat, F.lit(single)).otherwise(inner).cast("int")


def histogram(
    df: DataFrame, column: str, bins: int = 50, by: Iterable[str] = (),
) -> DataFrame:
    """Counts in equal-width bins between each group's least and greatest value."""
    by = list(by)
    present = df.where(F.col(column).isNotNull())
    ranges = _ranges(present, [column], by)
    low, high = F.col(f"{column}__lo"), F.col(f"{column}__hi")
    flat = high == low
    start = F.when(flat, low - 0.5).otherwise(low)
    width = F.when(flat, F.lit(1.0)).otherwise(high - low) / bins
    return (
        _join_ranges(present.select(*by, column), ranges, by)
        .groupBy(*by, f"{column}__lo", f"{column}__hi", _bin(column, bins, bins // 2).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*by, "bin", (start + F.col("bin") * width).alias("left_edge"),
                (start + (F.col("bin") + 1) * width).alias("right_edge"), "n")
    )


def density(
    df: DataFrame, column: str, grid: int = 200, by: Iterable[str] = (), fine_bins: int = 1000,
    overhang: float = 0.0,
) -> DataFrame:
    """Gaussian kernel density on a grid, Scott's bandwidth.

    The curve ends at the data's own limits, or ``overhang`` bandwidths beyond them.

    The kernel is summed over fine histogram bins, so the work after one pass over the rows depends
    on ``fine_bins`` and ``grid`` only.
    """
    by = list(by)
    bins = histogram(df, column, fine_bins, by)
    stats = df.groupBy(*by).agg(
        F.count(column).alias("__n"), F.stddev_samp(column).alias("__s"),
        F.min(column).alias("__lo"), F.max(column).alias("__hi"),
    )
    centre = (F.col("left_edge") + F.col("right_edge")) / 2
    binned = bins.select(*by, centre.alias("__x"), "n")
    if by:
        joined = binned.join(stage(stats, "density-stats"), by)
    else:
        only = stats.first()
        joined = binned.withColumns({c: F.lit(only[c]) for c in stats.columns})
    bandwidth = F.col("__s") * F.pow(F.col("__n").cast("double"), F.lit(-0.2))
    low, high = F.col("__lo") - overhang * bandwidth, F.col("__hi") + overhang * bandwidth
    point = low + F.col("step") * (high - low) / (grid - 1)
    z = (point - F.col("__x")) / bandwidth
    kernel = F.exp(-z * z / 2) / (bandwidth * math.sqrt(2 * math.pi))
    return (
        joined.where(bandwidth > 0)
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        .groupBy(*by, "step")
        .agg(F.first(point).alias("x"),
             F.sum(kernel * F.col("n") / F.col("__n")).alias("density"))
    )


def box_stats(df: DataFrame, column: str, by: str = "ticker") -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and outliers."""
    present = df.where(F.col(column).isNotNull()).select(by, column)
    quartiles = stage(
        exact_quantiles(
            present, column,
            {"q1": (0.25, "linear"), "median": (0.5, "linear"), "q3": (0.75, "linear")}, [by],
        ),
        "quartiles",
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    within = F.col(column).between(F.col("q1") - reach, F.col("q3") + reach)
    return present.join(quartiles, by).groupBy(by).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(within, F.col(column))).alias("whisker_low"),
        F.max(F.when(within, F.col(column))).alias("whisker_high"),
        F.count(F.when(~within, 1)).alias("n_outliers"),
    )


def line_points(df: DataFrame, x: str, y: str, hue: str) -> DataFrame:
    """Mean of ``y`` at each (x, hue) with a normal 95% interval (C4)."""
    half = 1.96 * F.col("std_y") / F.sqrt(F.col("n"))
    return (
        df.groupBy(x, hue)
        .agg(F.avg(y).alias("mean_y"), F.count(y).alias("n"), F.stddev_samp(y).alias("std_y"))
        .select(x, hue, "mean_y", "n", (F.col("mean_y") - half).alias("low"),
                (F.col("mean_y") + half).alias("high"))
    )


def pair_bins(
    df: DataFrame, columns: Sequence[str], hue: str, bins: int = 20,
) -> DataFrame:
    """Joint counts of every pair of columns by ``hue`` (C5): one row per occupied cell.

    A column's only value is its maximum too, so it falls into the last bin.
    """
    ranges = _ranges(df, columns, [])
    pairs = list(combinations(columns, 2))
    cells = F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                 _bin(a, bins, bins - 1).alias("bin_a"), _bin(b, bins, bins - 1).alias("bin_b"))
        for a, b in pairs
    ])
    return (
        _join_ranges(df.select(hue, *columns), ranges, [])
        .select(hue, F.explode(cells).alias("cell")).select(hue, "cell.*")
        .where(F.col("bin_a").isNotNull() & F.col("bin_b").isNotNull())
        .groupBy("column_a", "column_b", hue, "bin_a", "bin_b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def regime_timeline(df: DataFrame, label: str = "regime") -> DataFrame:
    """Date, volatility and regime in time order."""
    return df.select("ticker", "date", "atm_iv", label).orderBy("ticker", "date")


def regime_runs(df: DataFrame, label: str = "regime") -> DataFrame:
    """Stretches of days in one regime, the shaded bands of the timeline."""
    spec = Window.partitionBy("ticker").orderBy("date")
    changed = F.coalesce((F.lag(label).over(spec) != F.col(label)).cast("int"), F.lit(0))
    return (
        df.withColumn("__changed", changed)
        .withColumn("__run", F.sum("__changed").over(spec))
        .groupBy("ticker", "__run")
        .agg(F.first(label).alias(label), F.min("date").alias("first_date"),
             F.max("date").alias("last_date"), F.count(F.lit(1)).alias("days"))
        .drop("__run")
    )
