"""Daily volatility features by (date, ticker)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volsmith.config import WING_DELTA
from volsmith.functions.scalar import delta_distance
from volsmith.session import stage

DAY_KEYS = ["date", "ticker"]


def _distances(atm: bool, delta: float | None) -> dict[str, Column]:
    """Distance to each quoted point, NULL where a row cannot stand for it."""
    found = {"atm_iv": delta_distance(0.5, F.abs("delta"))} if atm else {}
    if delta is not None:
        found["put25_iv"] = F.when(F.col("cp_flag") == "P", delta_distance(-delta))
        found["call25_iv"] = F.when(F.col("cp_flag") == "C", delta_distance(delta))
    return found


def _nearest_by_day(df: DataFrame, distances: dict[str, Column], *means: Column) -> DataFrame:
    """One row a day: the volatility at each least distance, and ``means``.

    Ties go to the smaller symbol, then strike; a winner's missing volatility is kept. The least
    distances are plain minima, so raw rows are hashed and not sorted; only rows that reach a
    minimum are compared further. The small table of days is staged, so it is joined by its size.
    """
    measured = df.withColumns({f"__{name}": distance for name, distance in distances.items()})
    days = stage(
        measured.groupBy(*DAY_KEYS).agg(*[F.min(f"__{name}").alias(f"__least_{name}") for name in distances], *means), "days")
    least = days.select(*[F.col(k).alias(f"__{k}") for k in DAY_KEYS], *[f"__least_{name}" for name in distances])
    same_day = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in DAY_KEYS]
    wins = {name: F.col(f"__{name}") == F.col(f"__least_{name}") for name in distances}
    near = measured.join(least, same_day).where(reduce(lambda a, b: a | b, wins.values()))
    order = F.struct("symbol", "strike_price")
    picked = near.groupBy(*[f"__{k}" for k in DAY_KEYS]).agg(
        *[F.min_by("impl_volatility", F.when(won, order)).alias(name) for name, won in wins.items()])
    return days.join(picked, same_day, "left").drop(
        *[f"__{k}" for k in DAY_KEYS], *[f"__least_{name}" for name in distances])


def atm_iv(df: DataFrame) -> DataFrame:
    """At-the-money volatility: the row whose absolute delta is nearest 0.5."""
    return _nearest_by_day(df, _distances(True, None))


def wing_iv(df: DataFrame, delta: float = WING_DELTA) -> DataFrame:
    """Volatility of the put nearest -delta and the call nearest +delta (A10)."""
    return _nearest_by_day(df, _distances(False, delta))


def smile_shape(df: DataFrame) -> DataFrame:
    """Skew and curvature from the three volatilities; NULL without a wing."""
    put, call = F.col("put25_iv"), F.col("call25_iv")
    return df.withColumns({
        "skew": put - call, "curvature": (put + call) / 2 - F.col("atm_iv"),
    }).drop("put25_iv", "call25_iv")


def iv_std(df: DataFrame) -> DataFrame:
    """Sample deviation of volatility; NULL for a single row."""
    return df.groupBy(*DAY_KEYS).agg(F.stddev_samp("impl_volatility").alias("iv_std"))


def group_means(df: DataFrame, keys: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """Means of columns by group, NULLs skipped (A5)."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def daily_iv_features(df: DataFrame, delta: float = WING_DELTA) -> DataFrame:
    """All daily features: one hash aggregation of raw rows, and the rows at the least distances.

    Price differences are averaged as far as ``df`` has them.
    """
    greeks = [c for c in ("delta", "vega", "theta") if c in df.columns]
    diffs = [c for c in df.columns if c.startswith("price_diff_")]
    summary = _nearest_by_day(
        df, _distances(True, delta),
        F.stddev_samp("impl_volatility").alias("iv_std"),
        *[F.avg(c).alias(f"avg_{c}") for c in greeks],
        *[F.avg(c).alias(c) for c in diffs],
    )
    shaped = smile_shape(summary)
    return shaped.select(
        *DAY_KEYS, "atm_iv", "skew", "curvature", "iv_std", *[f"avg_{c}" for c in greeks], *diffs
    )
