"""Projections, predicates and filters."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volsmith.config import (
    DELTA_RANGE, KEPT_PRICE_DIFFS, MAX_RELATIVE_SPREAD, TENOR_DAYS, VOLUME_QUANTILE,
    WINSOR_QUANTILE,
)
from volsmith.functions.scalar import capped, days_between, relative_spread
from volsmith.operators.quantiles import exact_quantiles
from volsmith.session import stage


def select_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """P1."""
    return df.select(*columns)


def parse_dates(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """P2."""
    return df.withColumns({c: F.to_date(c) for c in columns})


def add_date_parts(df: DataFrame, column: str = "date") -> DataFrame:
    """Year, month and day of a date."""
    return df.withColumns({
        "year": F.year(column), "month": F.month(column), "day": F.dayofmonth(column),
    })


def annotate(df: DataFrame, **constants: Any) -> DataFrame:
    """Constant columns."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    """P5."""
    return df.drop(*columns)


def select_features(
    df: DataFrame, exclude: Iterable[str] = ("date", "ticker", "year"),
) -> list[str]:
    """Names of all columns that are not identifiers."""
    identifiers = set(exclude)
    return [c for c in df.columns if c not in identifiers]


def trim_price_diffs(df: DataFrame, keep: Iterable[str] = tuple(KEPT_PRICE_DIFFS)) -> DataFrame:
    """Drop the price differences that are not kept."""
    kept = set(keep)
    return df.drop(*[c for c in df.columns if c.startswith("price_diff_") and c not in kept])


def copy_column(df: DataFrame, source: str, name: str) -> DataFrame:
    """P7."""
    return df.withColumn(name, F.col(source))


def add_dte(df: DataFrame) -> DataFrame:
    """Days to expiry."""
    return df.withColumn("dte", days_between("exdate", "date"))


def where_range(df: DataFrame, column: str, low: Any, high: Any) -> DataFrame:
    """P9."""
    return df.where(F.col(column).between(low, high))


def where_in(df: DataFrame, column: str, values: Iterable[Any]) -> DataFrame:
    """P9."""
    return df.where(F.col(column).isin(list(values)))


def where_present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in every given column."""
    return df.dropna(how="any", subset=list(columns))


def liquidity_filter(
    df: DataFrame, max_spread: float = MAX_RELATIVE_SPREAD,
    delta: tuple[float, float] = DELTA_RANGE,
) -> DataFrame:
    """Quotes that can be traded on (P10). A NULL in any test drops the row."""
    return df.where(
        ((F.col("volume") > 0) | (F.col("open_interest") > 0))
        & (F.col("best_bid") > 0)
        & (F.col("best_offer") > 0)
        & (F.col("best_offer") >= F.col("best_bid"))
        & (relative_spread() < max_spread)
        & F.abs("delta").between(*delta)
    )


def tenor_filter(df: DataFrame, low: int = TENOR_DAYS[0], high: int = TENOR_DAYS[1]) -> DataFrame:
    """Quotes expiring in ``low`` to ``high`` days, with their ``dte``."""
    return add_dte(df).where(F.col("dte").between(low, high))


def volume_thresholds(
    df: DataFrame, q: float = VOLUME_QUANTILE, by: str = "ticker",
) -> DataFrame:
    """The volume quantile of each group: ``by``, ``volume_threshold``."""
    return exact_quantiles(df, "volume", {"volume_threshold": (q, "nearest")}, [by])


def volume_cap(
    df: DataFrame, q: float = VOLUME_QUANTILE, by: str = "ticker",
    thresholds: DataFrame | None = None,
) -> DataFrame:
    """Rows whose volume does not exceed their group's quantile.

    The thresholds are one staged row per group, so the join is a broadcast one while they are
    small and the quotes are not shuffled.
    """
    if thresholds is None:
        thresholds = stage(volume_thresholds(df, q, by), "volume-thresholds")
    return (
        df.join(thresholds.select(by, "volume_threshold"), by)
        .where(F.col("volume") <= F.col("volume_threshold"))
        .drop("volume_threshold")
    )


def winsorise(
    df: DataFrame, column: str = "impl_volatility", q: float = WINSOR_QUANTILE, by: str = "ticker",
) -> DataFrame:
    """Values above their group's linear quantile are set to it; NULL stays NULL."""
    caps = stage(exact_quantiles(df, column, {"__cap": (q, "linear")}, [by]), "winsor-caps")
    order = df.columns
    return (
        df.join(caps, by, "left").withColumn(column, capped(column, F.col("__cap"))).select(*order)
    )


def one_hot(
    df: DataFrame, column: str = "regime", categories: Iterable[Any] | None = None,
    prefix: str | None = None, max_categories: int = 1000,
) -> DataFrame:
    """0/1 columns ``<prefix>_<value>`` in place of ``column``.

    Give ``categories`` for a schema that does not depend on the data; otherwise the values
    present are looked up, and more than ``max_categories`` of them is an error.
    """
    if categories is None:
        seen = df.where(F.col(column).isNotNull()).select(column).distinct()
        categories = sorted(r[0] for r in seen.limit(max_categories + 1).collect())
        if len(categories) > max_categories:
            raise ValueError(f"{column} has more than {max_categories} values")
    prefix = column if prefix is None else prefix
    flags = {
        f"{prefix}_{v}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int")
        for v in categories
    }
    return df.withColumns(flags).drop(column)


def head(df: DataFrame, n: int, order: Iterable[str]) -> DataFrame:
    """The first ``n`` rows in ``order``."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, keys: Iterable[str], seed: int = 42) -> DataFrame:
    """``n`` random rows (P16): those with the least hashes of their keys and the seed.

    The draw does not depend on how rows are partitioned. It is a top-n, so each task passes on at
    most ``n`` rows.
    """
    keys = list(keys)
    drawn = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.orderBy(drawn, *keys).limit(n)
