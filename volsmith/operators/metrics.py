"""Forecast errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _errors(actual: str, forecast: str) -> list[Column]:
    error = F.col(actual) - F.col(forecast)
    return [F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae")]


def eval_overall(
    pairs: DataFrame, by: Sequence[str] = (), actual: str = "y", forecast: str = "yhat",
) -> DataFrame:
    """RMSE and MAE over all samples and steps."""
    return pairs.groupBy(*by).agg(*_errors(actual, forecast))


def eval_by_horizon(
    pairs: DataFrame, by: Sequence[str] = (), actual: str = "y", forecast: str = "yhat",
) -> DataFrame:
    """RMSE and MAE per step."""
    return eval_overall(pairs, [*by, "horizon"], actual, forecast)


def mean_path(
    pairs: DataFrame, by: Sequence[str] = (), actual: str = "y", forecast: str = "yhat",
) -> DataFrame:
    """Mean actual and mean forecast per step."""
    return pairs.groupBy(*by, "horizon").agg(
        F.avg(actual).alias("mean_actual"), F.avg(forecast).alias("mean_forecast")
    )


def regression_metrics(actual: str = "y", forecast: str = "yhat") -> list[Column]:
    """MAE, MSE, RMSE, R2, RMSLE and MAPE as aggregates; RMSLE is NULL with values below -1.

    Where the actual value never changes, R2 has nothing to explain: minus infinity, or NaN without an error.
    """
    y, p = F.col(actual), F.col(forecast)
    error = y - p
    squared = F.avg(error * error)
    unexplained = F.when(squared > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    # Told by least and greatest: the merged variance of equal values may differ from 0 by rounding.
    share = F.when(F.min(y) == F.max(y), unexplained).otherwise(F.try_divide(squared, F.var_pop(y)))
    floor = F.greatest(F.abs(y), F.lit(2.220446049250313e-16))
    logs = F.when((y > -1) & (p > -1), F.log1p(y) - F.log1p(p))
    return [
        F.avg(F.abs(error)).alias("mae"),
        squared.alias("mse"),
        F.sqrt(squared).alias("rmse"),
        (1 - share).alias("r2"),
        F.when(F.count(logs) == F.count(error), F.sqrt(F.avg(logs * logs))).alias("rmsle"),
        F.avg(F.abs(error) / floor).alias("mape"),
    ]


def setup_means(
    results: DataFrame, keys: Sequence[str] = ("ticker", "method", "pca"),
    scores: Sequence[str] = ("silhouettes", "stabilities"),
) -> DataFrame:
    """Mean of each score list over the runs of a set-up, 0 without any."""
    means = []
    for name in scores:
        total = F.sum(F.aggregate(F.coalesce(name, F.array().cast("array<double>")), F.lit(0.0),
                                  lambda acc, v: acc + v))
        count = F.sum(F.coalesce(F.array_size(name), F.lit(0)))
        means.append(F.coalesce(F.try_divide(total, count), F.lit(0.0)).alias(f"mean_{name}"))
    return results.groupBy(*keys).agg(*means)
