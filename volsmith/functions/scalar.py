"""Scalar expressions on quotes, dates, labels and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mid_price(bid: str = "best_bid", offer: str = "best_offer") -> Column:
    return (F.col(bid) + F.col(offer)) / 2


def relative_spread(bid: str = "best_bid", offer: str = "best_offer") -> Column:
    return (F.col(offer) - F.col(bid)) / mid_price(bid, offer)


def delta_distance(target: float, delta: str | Column = "delta") -> Column:
    """How far an option's delta is from ``target``."""
    return F.abs((F.col(delta) if isinstance(delta, str) else delta) - F.lit(target))


def capped(value: str, cap: Column) -> Column:
    """``value`` limited to ``cap``; NULL stays NULL (``F.least`` would return the cap)."""
    return F.when(F.col(value) > cap, cap).otherwise(F.col(value))


def days_between(end: str, start: str) -> Column:
    return F.datediff(F.col(end), F.col(start))


def iso_timestamp(moment: Column | None = None) -> Column:
    moment = F.current_timestamp() if moment is None else moment
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def run_label(*columns: str) -> Column:
    """A lower-case label joined by underscores."""
    return F.concat_ws("_", *[F.lower(F.col(c).cast("string")) for c in columns])


def traditional_label(model: str = "model") -> Column:
    return F.format_string("Traditional (%s)", F.col(model))


def label_part(label: str, position: int, separator: str = "_") -> Column:
    """Part ``position`` (from 0) of a joined label, NULL when it has fewer parts."""
    return F.get(F.split(F.col(label), separator), F.lit(position))


def to_json_doc(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def from_json_doc(document: str, schema: str) -> Column:
    return F.from_json(F.col(document), schema)


def fibonacci_lags(max_days: int) -> list[int]:
    """1, 2, 3, 5, 8, ... up to ``max_days``."""
    lags: list[int] = []
    step, following = 1, 2
    while step <= max_days:
        lags.append(step)
        step, following = following, step + following
    return lags
