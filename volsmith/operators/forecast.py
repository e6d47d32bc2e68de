"""Baseline regressors, the multi-step forecaster and their comparison."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volsmith.config import EWMA_ALPHA
from volsmith.functions.arrays import (
    array_mean, ewma, flat_window, leading_feature, target, window_feature,
)
from volsmith.functions.scalar import traditional_label
from volsmith.operators.joins import union_results
from volsmith.operators.least_squares import (
    Linear, cross_products, in_blocks, left_out_models, predicted, validated_models,
)
from volsmith.operators.metrics import regression_metrics
from volsmith.operators.ranking import top_n_per_group
from volsmith.operators.sequences import explode_horizon, time_series_split
from volsmith.session import fit_side_by_side, stage

METRICS = ["mae", "mse", "rmse", "r2", "rmsle", "mape"]


def window_summary(n_features: int, x: str = "x") -> Column:
    """A window as a short vector: shape of the leading feature, level and mean of the others.

    Flattened windows reach thousands of columns; trees and regularised models do as well on this.
    """
    lead = leading_feature(x)
    parts: list[Column] = [
        F.element_at(lead, -1), ewma(lead, EWMA_ALPHA), array_mean(lead), F.array_min(lead),
        F.array_max(lead), F.element_at(lead, -1) - F.get(lead, F.lit(0)),
        array_mean(F.slice(lead, F.greatest(F.size(lead) - 4, F.lit(1)), 5)),
    ]
    for j in range(1, n_features):
        series = window_feature(x, j)
        parts += [F.element_at(series, -1), array_mean(series)]
    return F.array(*parts)


def _feature_count(sequences: DataFrame) -> int:
    first = sequences.select(F.array_size(F.col("x")[0])).first()
    return int(first[0]) if first else 0


Candidate = Linear | Callable[[], Estimator]


def baseline_regressors(seed: int = 42) -> dict[str, Candidate]:
    """The models compared by default: linear ones from cross products, the others fitted by Spark ML."""
    common: dict[str, Any] = {"featuresCol": "features", "labelCol": "y"}
    return {
        "linear": Linear(),
        "ridge": Linear(0.1),
        "lasso": Linear(0.01, 1.0),
        "elastic_net": Linear(0.01, 0.5),
        "generalized_linear": Linear(1e-4),
        "huber": lambda: LinearRegression(loss="huber", regParam=1e-4, **common),
        "decision_tree": lambda: DecisionTreeRegressor(maxDepth=5, seed=seed, **common),
        "random_forest": lambda: RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed,
                                                       **common),
        "gbt": lambda: GBTRegressor(maxIter=10, maxDepth=3, seed=seed, **common),
    }


#: Fold number of the rows that models are finally scored on.
TEST = -1


def regression_rows(
    sequences: DataFrame, by: Sequence[str], targets: Sequence[bool], folds: int,
    alpha: float = EWMA_ALPHA,
) -> DataFrame:
    """Staged rows of every set-up: by, end_date, fold, features (flat), summary, targets, ewma.

    Each set-up and ticker is split by time; its last 20% are fold ``TEST``, the earlier rows are cut
    into stretches, because neighbouring windows overlap. ``targets`` tells for each target whether it
    is the mean over the horizon (else its first step).
    """
    series = [*by, *([] if "ticker" in by else ["ticker"])]
    named = sequences.withColumn("series", F.concat_ws("|", *[F.col(c).cast("string") for c in series]))
    split = time_series_split(named, mode="ticker", by="series")
    early = F.col("part") != "test"
    sizes = Window.partitionBy("series")
    fold = F.floor(F.col("position") * folds / F.count(F.when(early, 1)).over(sizes))
    width = _feature_count(sequences)
    summary = window_summary(width) if width else F.array().cast("array<double>")
    return stage(split.select(
        *by, "series", "end_date", F.when(early, fold).otherwise(TEST).cast("int").alias("fold"),
        flat_window("x").cast("array<double>").alias("features"), summary.alias("summary"),
        F.array(*[target("y", mean) for mean in targets]).alias("targets"),
        ewma(leading_feature("x"), alpha).alias("ewma"),
    ), "regression-rows")


def _linear_pairs(rows: DataFrame, by: Sequence[str], models: Mapping[str, Linear], flat: bool) -> DataFrame:
    """by, fold, model, position, y, yhat of held-out rows; one read for all folds and models, one to predict."""
    used = rows if flat else rows.drop("features").withColumnRenamed("summary", "features")
    keyed = used.withColumn("place", F.concat_ws("|", "series", F.col("end_date").cast("string")))
    blocked = in_blocks(keyed, by, "place")
    products = cross_products(blocked.where(F.col("fold") != TEST), by, "place")
    fitted = stage(left_out_models(products, by, models, TEST), "coefficients")
    pairs = predicted(blocked, fitted, by, ["fold", "place"])
    return pairs.select(*by, "fold", "model", F.posexplode(F.arrays_zip("y", "yhat")).alias("position", "pair")).select(
        *by, "fold", "model", "position", "pair.y", "pair.yhat")


def _estimator_pairs(rows: DataFrame, by: Sequence[str], models: Mapping[str, Callable[[], Estimator]],
                     folds: int, n_targets: int) -> list[DataFrame]:
    """The same for Spark ML models on window summaries: one fit for each set-up, target, model and fold."""
    spark = rows.sparkSession
    vectors = rows.withColumn("features", array_to_vector("summary")).drop("summary").persist()
    setups = [row.asDict() for row in rows.select(*by).distinct().collect()]

    def fit(task: tuple[dict, int, str, int]) -> DataFrame:
        setup, position, name, held = task
        own = vectors.withColumn("y", F.col("targets")[position])
        for key, value in setup.items():
            own = own.where(F.col(key) == F.lit(value))
        seen = own.where((F.col("fold") != held) & (F.col("fold") != TEST))
        model = models[name]().setPredictionCol("yhat").fit(seen)
        return model.transform(own.where(F.col("fold") == held)).select(
            *by, "fold", F.lit(name).alias("model"), F.lit(position).alias("position"), "y", "yhat")

    held = [*(range(folds) if folds > 1 else []), TEST]
    present = {(*(r[k] for k in by), r["fold"]) for r in rows.select(*by, "fold").distinct().collect()}
    tasks = [(s, p, name, h) for s in setups for p in range(n_targets) for name in models for h in held
             if (*s.values(), h) in present and any((*s.values(), f) in present for f in range(folds) if f != h)]
    predictions = fit_side_by_side(spark, fit, tasks)
    pairs = [stage(union_results(*predictions), "pairs")] if predictions else []
    vectors.unpersist()
    return pairs


def compare_setups(
    rows: DataFrame, by: Sequence[str], targets: Sequence[bool], folds: int = 10,
    models: Mapping[str, Candidate] | None = None, n_best: int | None = 5, flat: bool = True, seed: int = 42,
) -> DataFrame:
    """Models of every set-up ranked by cross-validated MAE, each set-up's best and EWMA scored on its test rows.

    ``rows`` come from ``regression_rows``. Linear models of all set-ups come from one aggregation of
    cross products, over flattened windows (``flat=False``: over their summaries).
    """
    candidates = dict(models or baseline_regressors(seed))
    linear = {n: m for n, m in candidates.items() if isinstance(m, Linear)}
    others = {n: m for n, m in candidates.items() if not isinstance(m, Linear)}
    parts = [stage(_linear_pairs(rows, by, linear, flat), "pairs")] if linear else []
    parts += _estimator_pairs(rows, by, others, folds, len(targets)) if others else []
    pairs = union_results(*parts)
    keys = [*by, "position", "model"]
    tested = pairs.where(F.col("fold") == TEST).groupBy(*keys).agg(*regression_metrics("y", "yhat"))
    validated = pairs.where((F.col("fold") != TEST) & F.lit(folds > 1)).groupBy(*keys).agg(
        F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("cv_mae"))
    ranked = tested.join(validated, keys, "left").withColumn("rank", F.row_number().over(
        Window.partitionBy(*by, "position").orderBy(F.asc_nulls_last("cv_mae"), "model")))
    kept = ranked if n_best is None else ranked.where(F.col("rank") <= n_best)
    weighted = rows.where(F.col("fold") == TEST).select(
        *by, F.posexplode("targets").alias("position", "y"), "ewma").groupBy(*by, "position").agg(
            *regression_metrics("y", "ewma")).withColumns(
                {"model": F.lit("EWMA"), "cv_mae": F.lit(None).cast("double"), "rank": F.lit(None).cast("int")})
    columns = [*by, "position", "model", "cv_mae", *METRICS]
    both = kept.select(*columns, "rank").union(weighted.select(*columns, "rank"))
    settled = [F.round(c, 12).alias(c) for c in ("cv_mae", *METRICS)]  # sums are taken in no fixed order
    return both.orderBy(*by, "position", F.asc_nulls_last("rank")).select(*by, "position", "model", *settled)


def compare_regressors(
    sequences: DataFrame, use_mean: bool = False, folds: int = 10,
    models: Mapping[str, Candidate] | None = None, n_best: int | None = 5,
    flat: bool = True, alpha: float = EWMA_ALPHA, seed: int = 42, by: Sequence[str] = (),
) -> DataFrame:
    """Baselines ranked by cross-validated MAE and scored on the same test rows as EWMA.

    The last 20% of each ticker's windows are the test rows. Folds are stretches of the earlier ones.
    One comparison over all tickers, or one for each value of ``by``. Linear models take flattened
    windows, trees and the huber model their summaries. An empty input gives an empty table.
    """
    keys = list(by) or ["every"]
    keyed = sequences if by else sequences.withColumn("every", F.lit(0))
    rows = regression_rows(keyed, keys, [use_mean], folds, alpha)
    found = compare_setups(rows, keys, [use_mean], folds, models, n_best, flat, seed)
    return found.drop("position", *([] if by else ["every"]))


@dataclass
class DirectForecast:
    """The chosen model, its test predictions in long form and the table of trials."""

    model: Model
    predictions: DataFrame
    trials: DataFrame


# The settings that trials are drawn from.
TRIAL_GRID = {
    "kind": ["gbt", "forest", "linear"],
    "depth": [2, 3, 4, 5],
    "rounds": [5, 10, 20],
    "penalty": [0.0, 0.001, 0.01, 0.1],
}


def _draw(grid: Mapping[str, Sequence[Any]], trials: int, seed: int) -> list[dict[str, Any]]:
    generator = random.Random(seed)
    drawn: list[dict[str, Any]] = []
    for _ in range(100 * trials):
        candidate = {name: generator.choice(list(values)) for name, values in grid.items()}
        if candidate not in drawn:
            drawn.append(candidate)
        if len(drawn) == trials:
            break
    return drawn


def _regressor(setting: Mapping[str, Any], seed: int) -> Estimator:
    common: dict[str, Any] = {
        "featuresCol": "features", "labelCol": "y", "predictionCol": "yhat",
    }
    if setting["kind"] == "linear":
        return LinearRegression(regParam=setting["penalty"], **common)
    if setting["kind"] == "forest":
        return RandomForestRegressor(numTrees=setting["rounds"], maxDepth=setting["depth"],
                                     seed=seed, **common)
    return GBTRegressor(maxIter=setting["rounds"], maxDepth=setting["depth"], seed=seed, **common)


def _scores(predicted: DataFrame) -> dict[str, float | None]:
    return predicted.agg(*regression_metrics("y", "yhat")).first().asDict()


def _horizon_rows(sequences: DataFrame) -> DataFrame:
    """One row for each window and step of its horizon: ticker, end_date, part, horizon, y, features."""
    split = time_series_split(sequences, mode="ticker")
    long = explode_horizon(
        split.withColumn("summary", window_summary(_feature_count(sequences))), "y",
        keys=["ticker", "end_date", "part", "summary"],
    )
    step = F.array(F.col("horizon").cast("double"))
    return long.select("ticker", "end_date", "part", "horizon", "y",
                       array_to_vector(F.concat("summary", step)).alias("features"))


def _test_forecasts(model: Model, rows: DataFrame) -> DataFrame:
    return model.transform(rows.where(F.col("part") == "test")).select(
        "ticker", "end_date", "horizon", "y", "yhat")


def predict_test(model: Model, sequences: DataFrame) -> DataFrame:
    """The forecasts of a ``direct_forecast`` model for the test part of the sequences."""
    return _test_forecasts(model, _horizon_rows(sequences))


def direct_forecast(
    sequences: DataFrame, grid: Mapping[str, Sequence[Any]] | None = None, max_trials: int = 10,
    seed: int = 42,
) -> DirectForecast:
    """Forecast every step of the horizon with one model that knows the step.

    Trials are seeded draws from the grid, fitted on the training part and chosen by squared error
    on the validation part; the choice is refitted on both and predicts the test part.
    """
    spark = sequences.sparkSession
    rows = stage(_horizon_rows(sequences), "horizon-rows").persist()
    training = rows.where(F.col("part") == "train")
    validation = rows.where(F.col("part") == "validation")

    def attempt(task: tuple[int, dict[str, Any]]) -> tuple[float | None, int, dict[str, Any]]:
        number, setting = task
        model = _regressor(setting, seed).fit(training)
        return _scores(model.transform(validation))["mse"], number, setting

    drawn = enumerate(_draw(grid or TRIAL_GRID, max_trials, seed))
    tried = fit_side_by_side(spark, attempt, drawn)
    best = min(tried, key=lambda t: (t[0] is None, t[0], t[1]))[2]
    model = _regressor(best, seed).fit(rows.where(F.col("part") != "test"))
    predictions = stage(_test_forecasts(model, rows), "predictions")
    rows.unpersist()
    table = spark.createDataFrame(
        [(n, s["kind"], s["depth"], s["rounds"], float(s["penalty"]), loss)
         for loss, n, s in tried],
        "trial int, kind string, depth int, rounds int, penalty double, val_loss double",
    )
    return DirectForecast(model, predictions, table)


#: Penalties and inputs that grouped forecasts are drawn from: ten trials.
PENALTIES = (0.001, 0.01, 0.1, 1.0, 10.0)
INPUTS = ("flat", "summary")
PARTS = {"train": 0, "validation": 1, "test": 2}


@dataclass
class GroupForecast:
    """Test predictions in long form, all trials with the chosen one marked, and its coefficients."""

    predictions: DataFrame
    trials: DataFrame
    coefficients: DataFrame


def forecast_by_group(
    sequences: DataFrame, by: Sequence[str] = ("ticker",), penalties: Sequence[float] = PENALTIES,
    inputs: Sequence[str] = INPUTS,
) -> GroupForecast:
    """A forecaster for every group: all steps of the horizon by least squares on the window.

    A trial is a kind of input and a penalty. Its coefficients follow from the cross products of the
    group's training part and its squared error from those of the validation part; the best trial
    is fitted again on both and predicts the test part. The rows are read once for the sums and once for
    the predictions, whatever the number of groups, steps and trials.
    """
    by = list(by)
    width = _feature_count(sequences)
    split = time_series_split(sequences.withColumn("series", F.concat_ws("|", *[F.col(c).cast("string") for c in by])), mode="ticker", by="series")
    codes = F.create_map(*[F.lit(v) for pair in PARTS.items() for v in pair])
    kinds = {"flat": flat_window("x"), "summary": window_summary(max(width, 1))}
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("input"), kinds[k].cast("array<double>").alias("features")) for k in inputs]))
    rows = stage(split.select(
        *by, "end_date", codes[F.col("part")].cast("int").alias("fold"), F.col("y").cast("array<double>").alias("targets"),
        both.alias("own")).select(*by, "end_date", "fold", "targets", "own.*"), "forecast-rows")
    keys = [*by, "input"]
    blocked = in_blocks(rows, keys, "end_date")
    products = cross_products(blocked.where(F.col("fold") != PARTS["test"]), keys)
    models = {f"ridge {p:g}": Linear(p) for p in penalties}
    fitted = stage(validated_models(products, keys, models, PARTS["train"], PARTS["validation"]), "trials")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("loss", "input", "model"))
    trials = stage(fitted.withColumn("chosen", place == 1), "ranked-trials")
    best = trials.where("chosen").drop("loss", "chosen")
    pairs = predicted(blocked.where(F.col("fold") == PARTS["test"]), best, keys, ["end_date"])
    named = pairs.withColumn("model", F.concat_ws(" ", "model", "input"))
    long = stage(explode_horizon(named, "y", "yhat", keys=[*by, "end_date", "model"]), "predictions")
    shown = trials.select(*by, "input", "model", F.col("loss").alias("val_loss"), "chosen")
    return GroupForecast(long, shown, best)


def forecast_errors(predictions: DataFrame, by: Sequence[str] = ("ticker", "model")) -> DataFrame:
    """MAE and RMSE over all steps and the MAE of the first one."""
    error = F.col("y") - F.col("yhat")
    return predictions.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(F.when(F.col("horizon") == 1, F.abs(error))).alias("mae_one_step"),
        F.sqrt(F.avg(error * error)).alias("rmse"))


def compare_best(deep: DataFrame, traditional: DataFrame) -> DataFrame:
    """The forecaster's result beside each ticker's best baseline."""
    best = top_n_per_group(traditional, "ticker", "mae", 1, tie=["model"])
    labelled = best.select(traditional_label().alias("model"), "ticker", "mae")
    return union_results(deep.select("model", "ticker", "mae"), labelled)
