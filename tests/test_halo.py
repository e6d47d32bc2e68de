"""Halos of chunked windows: narrow beside long dates, and wide enough where few rows have a target."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from volsmith.operators import chunks, lags


def quotes(spark, dates, rows, missing):
    """``rows`` on each of ``dates`` dates for two securities, a volatility missing in ``missing`` of 10 rows."""
    return spark.range(2 * dates * rows).select(
        (F.col("id") % 2).cast("double").alias("secid"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 2 % dates).cast("int")).alias("date"),
        (F.xxhash64("id") % 500).cast("double").alias("strike_price"), F.col("id").cast("string").alias("symbol"),
        F.when(F.abs(F.xxhash64("id", F.lit(1))) % 10 >= missing, F.col("id") % 97 / 100).alias("impl_volatility"),
        (F.col("id") % 89).cast("double").alias("prc"))


@pytest.mark.parametrize(("dates", "rows", "missing"), [(3, 1500, 1), (40, 60, 9), (1, 3000, 3)])
def test_target_and_differences_in_one_go(spark, dates, rows, missing):
    df = quotes(spark, dates, rows, missing).persist()
    steps = lags.price_differences(lags.lead_target(df, 5, chunk_rows=None), 40, chunk_rows=None)
    found = lags.target_and_differences(df, 5, 40, chunk_rows=200)
    assert found.columns == steps.columns
    assert found.count() == steps.count() > 0
    assert found.exceptAll(steps).isEmpty() and steps.exceptAll(found).isEmpty()


def test_few_rows_are_sent_twice(spark):
    df = quotes(spark, 4, 3000, 0).persist()
    spread = chunks._spread(df, ["secid"], lags.QUOTE_ORDER, 20, 5, 2000)
    assert spread.where("__own").count() == df.count()
    assert spread.count() < 1.2 * df.count()
