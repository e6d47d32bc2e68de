"""Equi-joins of quotes, prices, names, rates and labels.

No join carries a broadcast hint: names, masters and rates are small files, so the optimiser
broadcasts them by their measured size, and a side that has outgrown the threshold is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_master(quotes: DataFrame, master: DataFrame, tickers: Iterable[str]) -> DataFrame:
    """Quotes with the ticker of their security, for the wanted tickers."""
    wanted = master.where(F.col("ticker").isin(list(tickers))).select("secid", "ticker")
    return quotes.drop("ticker").join(wanted, "secid")


def join_names(prices: DataFrame, names: DataFrame, dedupe: bool = False) -> DataFrame:
    """Prices with the tickers listed under their cusip.

    Names have no validity dates: several rows of one cusip multiply its prices. ``dedupe``
    joins each (cusip, ticker) once instead.
    """
    listed = names.select("cusip", "ticker")
    return prices.join(listed.distinct() if dedupe else listed, "cusip")


def join_stock(quotes: DataFrame, stock: DataFrame, suffix: str = "_stock") -> DataFrame:
    """Quotes with the price of their ticker and day, NULL where there is none."""
    keys = ["ticker", "date"]
    clashing = [c for c in stock.columns if c not in keys and c in quotes.columns]
    renamed = stock.withColumnsRenamed({c: c + suffix for c in clashing})
    return quotes.join(renamed, keys, "left")


def join_rates(features: DataFrame, rates: DataFrame) -> DataFrame:
    """Features with the rates of their day, NULL on days without one."""
    return features.join(rates, "date", "left")


def attach_labels(df: DataFrame, labels: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows with the cluster label found under the same keys."""
    return df.join(labels, list(keys), "left")


def pair_predictions(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Actual and predicted values of one window and horizon step."""
    return truth.join(predicted, ["ticker", "end_date", "horizon"])


def union_frames(*frames: DataFrame) -> DataFrame:
    """Stack frames of the same columns."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_results(*frames: DataFrame) -> DataFrame:
    """Stack result tables whose columns may differ; duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
