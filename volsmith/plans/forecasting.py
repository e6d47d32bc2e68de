"""From labelled daily features to sequences, baselines, forecasts and their comparison."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volsmith.config import SCALED_FEATURES
from volsmith.operators.clean import copy_column, one_hot, trim_price_diffs
from volsmith.operators.forecast import (
    Candidate, GroupForecast, compare_best, compare_setups, forecast_by_group, forecast_errors, regression_rows,
)
from volsmith.operators.joins import union_results
from volsmith.operators.ranking import top_n_per_group
from volsmith.operators.scaling import fit_scaler, standardise, unscale
from volsmith.operators.sequences import build_sequences, build_window_sets, time_series_split
from volsmith.session import stage

TARGET = "__target"
SETUP = ["ticker", "w", "rates", "regime"]


@dataclass
class ScaledDays:
    """Scaled daily features, the columns that models read, and the scaler of each ticker."""

    days: DataFrame
    used: list[str]
    stats: DataFrame


def scaled_days(
    daily: DataFrame, rates: bool = False, regime: bool = False, features: Sequence[str] | None = None,
    categories: Iterable[Any] | None = None, fit_on: str = "all", train: float = 0.6,
) -> ScaledDays:
    """Each ticker's features scaled on its own, with a copy of the leading one as the target.

    ``fit_on='train'`` fits on the first ``train`` share of a ticker's days, so that nothing later
    leaks into the inputs.
    """
    columns = list(features or [c for c in SCALED_FEATURES if c in daily.columns])
    if rates:
        columns.append("treasury_2y")
    trimmed = copy_column(trim_price_diffs(daily), columns[0], TARGET)
    fitted = trimmed
    if fit_on == "train":
        # One row a day and ticker: days are placed by the same rule that splits sequences.
        placed = time_series_split(trimmed, train=train, validation=0.0, order="date")
        fitted = placed.where(F.col("part") == "train").drop("part", "position")
    elif fit_on != "all":
        raise ValueError("fit_on is 'all' or 'train'")
    scaled_columns = [*columns, TARGET]
    stats = stage(fit_scaler(fitted, scaled_columns, ["ticker"]), "scaler")
    scaled = standardise(trimmed, scaled_columns, stats, ["ticker"])
    used = list(columns)
    if regime:
        before = set(scaled.columns)
        scaled = one_hot(scaled, "regime", categories)
        used += [c for c in scaled.columns if c not in before]
    return ScaledDays(scaled, used, stats)


def feature_extraction(
    daily: DataFrame, rates: bool = False, regime: bool = False, W: int = 180, H: int = 30,
    features: Sequence[str] | None = None, categories: Iterable[Any] | None = None,
    fit_on: str = "all", train: float = 0.6,
) -> DataFrame:
    """Scaled sequences of one or several tickers, see ``scaled_days``."""
    scaled = scaled_days(daily, rates, regime, features, categories, fit_on, train)
    return build_sequences(scaled.days, scaled.used, TARGET, W, H)


@dataclass
class SetupSequences:
    """Sequences of all set-ups in one staged table (``SETUP``, end_date, x, y) and the tickers' scalers."""

    sequences: DataFrame
    stats: DataFrame


def setup_sequences(
    daily: DataFrame, windows: Sequence[int] = (180, 240), H: int = 30, rates: Sequence[bool] = (False,),
    regimes: Sequence[bool] = (False,), features: Sequence[str] | None = None,
    categories: Iterable[Any] | None = None, fit_on: str = "train",
) -> SetupSequences:
    """Windows of every ticker, length and choice of inputs: one job, the set-up is part of the key."""
    categories = None if categories is None else list(categories)
    parts = []
    for with_rates in rates:
        for with_regime in regimes:
            scaled = scaled_days(daily, with_rates, with_regime, features, categories, fit_on)
            built = build_window_sets(scaled.days, scaled.used, TARGET, windows, H)
            parts.append(built.select(
                "ticker", "w", F.lit(with_rates).alias("rates"), F.lit(with_regime).alias("regime"), "end_date", "x", "y"))
    return SetupSequences(stage(union_results(*parts), "setup-sequences"), scaled.stats)


def rank_grid(results: DataFrame, n_best: int = 5) -> DataFrame:
    """The ``n_best`` rows of each ticker by MAE and its best EWMA row, which may then appear twice."""
    ties = ["model", "w", "rates", "regime", "use_mean"]
    weighted = top_n_per_group(results.where(F.col("model") == "EWMA"), "ticker", "mae", 1, ties)
    return union_results(top_n_per_group(results, "ticker", "mae", n_best, ties), weighted)


def run_grid(
    built: SetupSequences, H: int = 30, use_mean: Sequence[bool] = (True,), n_best: int = 5, folds: int = 10,
    models: Mapping[str, Candidate] | None = None, **settings,
) -> tuple[DataFrame, DataFrame]:
    """Baselines over ticker x window x flags, and the ranked rows of each ticker.

    All linear models of the grid come from one aggregation; trees are fitted side by side.
    """
    rows = regression_rows(built.sequences, SETUP, use_mean, folds)
    found = compare_setups(rows, SETUP, use_mean, folds, models, n_best=None, **settings)
    which = F.array(*[F.lit(bool(m)) for m in use_mean])[F.col("position")]
    results = stage(found.withColumns({"use_mean": which, "h": F.lit(H)}).drop("position"), "grid")
    return results, rank_grid(results, n_best)


@dataclass
class TickerForecasts:
    """Each ticker's chosen forecaster: predictions in original units and errors in both units."""

    predictions: DataFrame
    errors: DataFrame
    trials: DataFrame
    coefficients: DataFrame


def forecast_tickers(built: SetupSequences, **settings) -> TickerForecasts:
    """The best set-up of each ticker by validation error, its test forecasts and their errors.

    ``errors`` has mae, mae_one_step and rmse in scaled units and with ``_units`` in those of the target.
    """
    found: GroupForecast = forecast_by_group(built.sequences, SETUP, **settings)
    best = top_n_per_group(found.trials.where("chosen"), "ticker", "val_loss", 1, ["w", "rates", "regime"])
    chosen = stage(best.select(*SETUP), "chosen-setups")
    scaled = stage(found.predictions.join(chosen, SETUP), "scaled-forecasts")
    units = scaled
    for column in ("y", "yhat"):
        units = unscale(units, column, built.stats, TARGET, ["ticker"])
    units = stage(units, "forecasts")
    by = [*SETUP, "model"]
    errors = forecast_errors(scaled, by).join(
        forecast_errors(units, by).withColumnsRenamed({c: f"{c}_units" for c in ("mae", "mae_one_step", "rmse")}), by)
    return TickerForecasts(units, errors, found.trials, found.coefficients.join(chosen, SETUP, "left_semi"))


def forecast_comparison(
    daily: DataFrame, windows: Sequence[int] = (180, 240), H: int = 30, rates: Sequence[bool] = (False,),
    regimes: Sequence[bool] = (False,), use_mean: Sequence[bool] = (True,), folds: int = 10, n_best: int = 5,
    models: Mapping[str, Candidate] | None = None, features: Sequence[str] | None = None,
) -> DataFrame:
    """Each ticker's forecaster, by the MAE of its first step, beside its best baseline, by that of its target.

    The same windows, split and scaling serve both; scores are on the same test rows, in scaled units.
    """
    built = setup_sequences(daily, windows, H, rates, regimes, features)
    _, ranked = run_grid(built, H, use_mean, n_best, folds, models)
    errors = forecast_tickers(built).errors
    deep = errors.select("model", "ticker", F.col("mae_one_step").alias("mae"))
    return compare_best(deep, ranked)
