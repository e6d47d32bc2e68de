"""Forward targets and lagged price differences by security."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from volsmith.config import CHUNK_ROWS, MAX_PRICE_LAG, TARGET_LEAD_ROWS
from volsmith.functions.scalar import fibonacci_lags
from volsmith.operators.chunks import in_chunks, window_columns

# A total order of a security's rows, so that equal dates cannot swap between runs.
QUOTE_ORDER = ["date", "strike_price", "symbol"]


def _with_days(df: DataFrame, days: DataFrame, by: str, needed: str, require: bool) -> DataFrame:
    """``df`` with the columns of its security's day; ``needed`` has to be there if required."""
    joined = df.join(days, [by, "date"], "left")
    columns = [*df.columns, *[c for c in days.columns if c not in (by, "date")]]
    return (joined.where(F.col(needed).isNotNull()) if require else joined).select(*columns)


def _days(df: DataFrame, by: str, value: Column) -> tuple[DataFrame, Column]:
    """One row (by, date, ``__v``) for each trading day of a security, and the day's number to order by.

    A day's value is aggregated before the shuffle; what follows is bounded by the days of a security.
    """
    return df.groupBy(by, "date").agg(value.alias("__v")), F.unix_date("date")


def lead_target(
    df: DataFrame, n: int = TARGET_LEAD_ROWS, by: str = "secid",
    order: Sequence[str] = tuple(QUOTE_ORDER), chunk_rows: int | None = CHUNK_ROWS,
    require: bool = True, unit: str = "row",
) -> DataFrame:
    """``iv_30d``, the volatility ``n`` rows ahead (W1); rows without one are dropped.

    Rows are contracts, so ``n`` rows are not ``n`` days. With ``unit='day'`` it is the mean volatility of the
    security on its last trading day after the row's date and at most ``n`` days ahead; a row has none
    if the security does not trade on or after that day.
    """
    if unit == "day":
        days, number = _days(df, by, F.avg("impl_volatility"))
        ahead = Window.partitionBy(by).orderBy(number)
        reached = F.max(number).over(Window.partitionBy(by)) >= number + n
        target = F.when(reached, F.last("__v", ignorenulls=True).over(ahead.rangeBetween(1, n)))
        return _with_days(df, days.select(by, "date", target.alias("iv_30d")), by, "iv_30d", require)
    if unit != "row":
        raise ValueError("unit is 'row' or 'day'")
    return window_columns(
        df, [by], order,
        lambda w: {"iv_30d": F.lead("impl_volatility", n).over(w)},
        after=n, chunk_rows=chunk_rows,
        keep=(lambda d: d.where(F.col("iv_30d").isNotNull())) if require else None,
    )


def price_differences(
    df: DataFrame, max_days: int = MAX_PRICE_LAG, by: str = "secid",
    order: Sequence[str] = tuple(QUOTE_ORDER), chunk_rows: int | None = CHUNK_ROWS,
    require: bool = True, unit: str = "row",
) -> DataFrame:
    """``price_diff_{d}d`` = price minus the price d rows back, d = 1, 2, 3, 5, 8, ....

    All lags share one window, hence one shuffle and one sort. Rows whose longest difference is
    missing are dropped. With ``unit='day'`` the other price is that of the last day with a price at or
    before d days back: a range of each lag over one row a day (the day's greatest price, should it have
    several), looked up once for all contracts of the day.
    """
    if unit not in ("row", "day"):
        raise ValueError("unit is 'row' or 'day'")
    lags = fibonacci_lags(max_days)
    if not lags:
        return df
    longest = f"price_diff_{lags[-1]}d"
    if unit == "day":
        days, number = _days(df, by, F.max("prc"))
        past = Window.partitionBy(by).orderBy(number)
        earlier = {f"__{d}": F.last("__v", ignorenulls=True).over(past.rangeBetween(Window.unboundedPreceding, -d))
                   for d in lags}
        # The row's own price counts, the day's only looks back.
        found = _with_days(df, days.withColumns(earlier).drop("__v"), by, f"__{lags[-1]}", require)
        differences = {f"price_diff_{d}d": F.col("prc") - F.col(f"__{d}") for d in lags}
        found = found.withColumns(differences).drop(*earlier)
        return found.where(F.col(longest).isNotNull()) if require else found
    return window_columns(
        df, [by], order,
        lambda w: {f"price_diff_{d}d": F.col("prc") - F.lag("prc", d).over(w) for d in lags},
        before=lags[-1], chunk_rows=chunk_rows,
        keep=(lambda d: d.where(F.col(longest).isNotNull())) if require else None,
    )


def target_and_differences(
    df: DataFrame, n: int = TARGET_LEAD_ROWS, max_days: int = MAX_PRICE_LAG, by: str = "secid",
    order: Sequence[str] = tuple(QUOTE_ORDER), chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """``price_differences`` of the rows that ``lead_target`` keeps, with one shuffle and one sort for both.

    The differences count the rows with a target. Of the rows before a chunk, those with a volatility but for
    ``n`` are volatilities ahead of other such rows, so ``n`` more of them than the longest lag hold enough targets.
    """
    lags = fibonacci_lags(max_days)
    if not lags:
        return lead_target(df, n, by, order, chunk_rows)

    def both(rows: DataFrame, w: WindowSpec) -> DataFrame:
        targeted = rows.withColumn("iv_30d", F.lead("impl_volatility", n).over(w)).where(F.col("iv_30d").isNotNull())
        return targeted.withColumns({f"price_diff_{d}d": F.col("prc") - F.lag("prc", d).over(w) for d in lags})

    found = in_chunks(df, [by], order, both, before=n + lags[-1], after=n, chunk_rows=chunk_rows,
                      counted=F.col("impl_volatility").isNotNull())
    return found.where(F.col(f"price_diff_{lags[-1]}d").isNotNull())
