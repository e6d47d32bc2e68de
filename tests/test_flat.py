"""Columns of a single value: what the operators return where a deviation is 0."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from volsmith.operators import charts, metrics, profile, regimes
from volsmith.operators.stationarity import adf


def test_correlation_of_a_single_value_is_nan(spark):
    df = spark.range(0, 50, 1, 7).select(F.lit(0.1).alias("a"), F.col("id").cast("double").alias("b"))
    found = {(r["column_a"], r["column_b"]): r["correlation"] for r in profile.corr_matrix(df, ["a", "b"]).collect()}
    assert all(math.isnan(found[pair]) for pair in (("a", "a"), ("a", "b"), ("b", "a")))
    assert found["b", "b"] == pytest.approx(1.0)
    nothing = profile.corr_matrix(df.select(F.lit(None).cast("double").alias("a"), "b"), ["a", "b"]).collect()
    assert [r["correlation"] for r in nothing][:3] == [None] * 3


def test_unit_root_test_of_a_single_value_is_nan(spark):
    start = dt.date(2020, 1, 1)
    rows = [("A", start + dt.timedelta(days=i), 0.1) for i in range(40)]
    df = spark.createDataFrame(rows, "ticker string, date date, v double")
    for max_lag in (0, 2, None):
        row = adf(df, "v", max_lag=max_lag).first()
        assert math.isnan(row["adf_stat"]) and math.isnan(row["p_value"])
        assert (row["used_lag"], row["n_obs"]) == (0, 39)


def test_r2_of_a_single_actual_value(spark):
    df = spark.range(0, 60, 1, 7).select((F.col("id") % 2).alias("g"), F.lit(0.1).alias("y")).withColumn(
        "yhat", F.when(F.col("g") == 0, 0.2).otherwise(F.col("y")))
    found = {r["g"]: r["r2"] for r in df.groupBy("g").agg(*metrics.regression_metrics()).collect()}
    assert found[0] == -math.inf and math.isnan(found[1])


def test_pair_bins_put_a_single_value_into_the_last_bin(spark):
    df = spark.createDataFrame([(0, 5.0, 1.0), (0, 5.0, 2.0), (0, None, 2.0)], "hue int, a double, b double")
    found = {(r["bin_a"], r["bin_b"]): r["n"] for r in charts.pair_bins(df, ["a", "b"], "hue", 4).collect()}
    assert found == {(3, 0): 1, (3, 3): 1}


def test_all_components_without_any_variance(spark):
    df = spark.range(30).select(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    loadings = regimes.pca_by_variance(df, ["a", "b"], 1.0).loadings.collect()
    assert sorted(r["component"] for r in loadings) == [1, 1, 2, 2]
    assert all(math.isnan(r["ratio"]) for r in loadings)
