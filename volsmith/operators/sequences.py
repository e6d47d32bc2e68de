"""Forecasting windows and their time split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volsmith.functions.arrays import ewma, leading_feature
from volsmith.operators.chunks import positions, window_columns


def lookback(
    df: DataFrame, columns: Sequence[str], steps: int, by: str = "ticker", order: str = "date",
    chunk_rows: int | None = None,
) -> DataFrame:
    """``x``: the last ``steps`` rows of the columns, the current one last."""
    row = F.array(*[F.col(c).cast("double") for c in columns])
    return window_columns(
        df, [by], [order],
        lambda w: {"x": F.collect_list(row).over(w.rowsBetween(-(steps - 1), 0))},
        before=steps - 1, chunk_rows=chunk_rows,
    )


def lookahead(
    df: DataFrame, column: str, steps: int, by: str = "ticker", order: str = "date",
    chunk_rows: int | None = None,
) -> DataFrame:
    """``y``: the next ``steps`` present values of a column."""
    return window_columns(
        df, [by], [order],
        lambda w: {"y": F.collect_list(F.col(column).cast("double")).over(w.rowsBetween(1, steps))},
        after=steps, chunk_rows=chunk_rows,
    )


def build_sequences(
    df: DataFrame, features: Sequence[str], target: str, W: int = 60, H: int = 3,
    collect: Sequence[str] | None = None, by: str = "ticker", order: str = "date",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Every complete window: ``W`` rows of features ``x``, ``H`` later targets ``y`` (Q1).

    A window with any missing feature or target is left out. ``collect`` limits what ``x``
    carries (all features are still tested): baselines that read one feature need not hold
    rows x W x features numbers. One row per (ticker, date) bounds a ticker by its days, so the
    default is a plain window; ``chunk_rows`` spreads longer series.
    """
    carried = list(features) if collect is None else list(collect)
    row = F.array(*[F.col(c).cast("double") for c in carried])
    incomplete = F.greatest(*[F.col(c).isNull().cast("int") for c in features], F.lit(0))

    def columns(w) -> dict[str, Column]:
        past, future = w.rowsBetween(-(W - 1), 0), w.rowsBetween(1, H)
        return {
            "__rows": F.count(F.lit(1)).over(past),
            "__missing": F.sum("__incomplete").over(past),
            "x": F.collect_list("__row").over(past),
            "y": F.collect_list(F.col(target).cast("double")).over(future),
        }

    narrow = df.select(
        by, order, row.alias("__row"), incomplete.alias("__incomplete"), F.col(target)
    )
    whole = (F.col("__rows") == W) & (F.col("__missing") == 0) & (F.size("y") == H)
    built = window_columns(
        narrow, [by], [order], columns, before=W - 1, after=H, chunk_rows=chunk_rows,
        keep=lambda d: d.where(whole),
    )
    return built.select(by, F.col(order).alias("end_date"), "x", "y")


def build_window_sets(
    df: DataFrame, features: Sequence[str], target: str, windows: Sequence[int], H: int,
    by: str = "ticker", order: str = "date", chunk_rows: int | None = None,
) -> DataFrame:
    """``build_sequences`` for several window lengths at once, told apart by ``w``.

    The longest window is collected once; a shorter one is its end, and is complete by its own count
    of incomplete rows. Plain windows per ticker by default, as a ticker has one row a day.
    """
    row = F.array(*[F.col(c).cast("double") for c in features])
    incomplete = F.greatest(*[F.col(c).isNull().cast("int") for c in features], F.lit(0))
    longest = max(windows)

    def columns(w) -> dict[str, Column]:
        whole = {f"__whole{n}": (F.count(F.lit(1)).over(w.rowsBetween(-(n - 1), 0)) == n)
                 & (F.sum("__incomplete").over(w.rowsBetween(-(n - 1), 0)) == 0) for n in windows}
        return {**whole, "__x": F.collect_list("__row").over(w.rowsBetween(-(longest - 1), 0)),
                "y": F.collect_list(F.col(target).cast("double")).over(w.rowsBetween(1, H))}

    narrow = df.select(by, order, row.alias("__row"), incomplete.alias("__incomplete"), F.col(target))
    some = F.greatest(*[F.col(f"__whole{n}") for n in windows], F.lit(False)) & (F.size("y") == H)
    built = window_columns(
        narrow, [by], [order], columns, before=longest - 1, after=H, chunk_rows=chunk_rows,
        keep=lambda d: d.where(some))
    held = F.filter(F.array(*[F.when(F.col(f"__whole{n}"), F.lit(n)) for n in windows]), lambda n: n.isNotNull())
    return built.select(by, F.col(order).alias("end_date"), F.explode(held).alias("w"), "__x", "y").select(
        by, "end_date", "w", F.slice("__x", F.size("__x") - F.col("w") + 1, F.col("w")).alias("x"), "y")


def ewma_forecast(sequences: DataFrame, alpha: float, repeat: int | None = None) -> DataFrame:
    """``yhat``: the weighted mean of the first feature (Q2), or ``repeat`` copies of it."""
    value = ewma(leading_feature("x"), alpha)
    return sequences.withColumn("yhat", F.array_repeat(value, repeat) if repeat else value)


def time_series_split(
    df: DataFrame, train: float = 0.6, validation: float = 0.2, mode: str = "ticker",
    by: str = "ticker", order: str = "end_date", chunk_rows: int | None = None,
) -> DataFrame:
    """``part``: train, validation or test by time, cut points truncated (Q5).

    ``mode='ticker'`` cuts each ticker's own rows; ``mode='global'`` cuts the rows of all tickers
    laid end to end, which puts the last tickers whole into the test part.
    """
    if mode not in ("ticker", "global"):
        raise ValueError("mode is 'ticker' or 'global'")
    placed = positions(df, [by], [order], "__pos", chunk_rows)
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    if mode == "global":
        # One row per ticker: the only rows this window without partitions ever sees.
        laid = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select(
            by,
            F.coalesce(F.sum("__n").over(laid), F.lit(0)).alias("__offset"),
            F.sum("__n").over(Window.partitionBy()).alias("__n"),
        )
    else:
        sizes = sizes.withColumn("__offset", F.lit(0).cast("bigint"))
    position = F.col("__pos") + F.col("__offset")
    part = (
        F.when(position < F.floor(F.col("__n") * F.lit(train)), "train")
        .when(position < F.floor(F.col("__n") * F.lit(train + validation)), "validation")
        .otherwise("test")
    )
    return placed.join(sizes, by).select(*df.columns, position.alias("position"),
                                         part.alias("part"))


def explode_horizon(df: DataFrame, *arrays: str, keys: Sequence[str] = ("ticker", "end_date")):
    """Arrays of equal length in long form, ``horizon`` counted from 1."""
    zipped = F.arrays_zip(*arrays)
    return df.select(*keys, F.posexplode(zipped).alias("__h", "__z")).select(
        *keys, (F.col("__h") + 1).alias("horizon"), *[F.col(f"__z.{a}").alias(a) for a in arrays]
    )


def forecast_path(
    df: DataFrame, sample: str | None = None, by: str = "ticker", actual: str = "y",
    forecast: str = "yhat",
) -> DataFrame:
    """Forecast against actual of one window per ticker, in long form (Q6).

    ``sample`` is an end date; without it the last window of each ticker is shown.
    """
    if sample is None:
        last = df.groupBy(by).agg(
            F.max_by(F.struct("end_date", actual, forecast), "end_date").alias("s")
        ).select(by, "s.*")
    else:
        last = df.where(F.col("end_date") == F.lit(sample).cast("date"))
    return explode_horizon(last, actual, forecast, keys=[by, "end_date"])
