"""Grouped least squares, batched k-means and forecasts against direct computations."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_statistics import COLUMNS, START, blob_frame, blobs, brute_silhouette, frame  # noqa: F401
from volsmith.operators import forecast, indices, least_squares, lloyd, regimes, sequences
from volsmith.operators.least_squares import Linear
from volsmith.plans import forecasting
from volsmith.sources import sinks

MODELS = {"plain": Linear(), "ridge": Linear(0.3), "lasso": Linear(0.05, 1.0), "mixed": Linear(0.05, 0.5)}


@pytest.fixture(scope="module")
def table():
    """(group, day, fold, features, targets): two groups of unlike width, one with a constant feature."""
    rng = np.random.default_rng(8)
    rows = []
    for group, n, width in (("A", 90, 4), ("B", 61, 3)):
        x = rng.normal(size=(n, width)) * [1, 20, 0.1, 3][:width] + 5
        if group == "A":
            x[:, 2] = 7.0
        y = x @ rng.normal(size=(width, 2)) + rng.normal(size=(n, 2))
        rows += [(group, START + dt.timedelta(days=i), i % 3, x[i].tolist(), y[i].tolist()) for i in range(n)]
    return rows


@pytest.fixture(scope="module")
def products(spark, table):
    df = spark.createDataFrame(table, "g string, end_date date, fold int, features array<double>, targets array<double>")
    blocked = least_squares.in_blocks(df, ["g"], "end_date", block_rows=16).persist()
    return blocked, least_squares.cross_products(blocked, ["g"])


def direct(x, y, penalty):
    """Ridge in units of deviations by a plain solve; no penalty by least squares."""
    mean, spread = x.mean(0), x.std(0)
    live = spread > 0
    z = (x[:, live] - mean[live]) / spread[live]
    t = (y - y.mean(0)) / y.std(0)
    if penalty:
        b = np.linalg.solve(z.T @ z / len(z) + penalty * np.eye(live.sum()), z.T @ t / len(z))
    else:
        b = np.linalg.lstsq(z, t, rcond=None)[0]
    whole = np.zeros((x.shape[1], y.shape[1]))
    whole[live] = b * y.std(0) / spread[live][:, None]
    return np.vstack([y.mean(0) - mean @ whole, whole])


def test_left_out_folds_equal_refits(products, table):
    fitted = least_squares.left_out_models(products[1], ["g"], MODELS).collect()
    assert len(fitted) == 2 * 4 * 4
    for row in fitted:
        own = [r for r in table if r[0] == row["g"] and r[2] != row["fold"]]
        x, y = (np.array([r[i] for r in own]) for i in (3, 4))
        b = np.frombuffer(row["weights"]).reshape(-1, 2)
        model = MODELS[row["model"]]
        if not model.lasso:
            assert np.allclose(b, direct(x, y, model.penalty), rtol=1e-6, atol=1e-6)
            continue
        # At the least cost no coefficient can move: the slope of the error is met by the penalty's.
        live = x.std(0) > 0
        z, t = (x[:, live] - x[:, live].mean(0)) / x[:, live].std(0), (y - y.mean(0)) / y.std(0)
        unit = b[1:][live] * x[:, live].std(0)[:, None] / y.std(0)
        slope = z.T @ (t - z @ unit) / len(z) - model.penalty * (1 - model.lasso) * unit
        limit = model.penalty * model.lasso
        assert (np.abs(slope) <= limit + 1e-6).all()
        assert np.allclose(slope[unit != 0], limit * np.sign(unit[unit != 0]), atol=1e-6)


def test_predictions_take_the_model_of_their_fold(products, table):
    blocked, sums = products
    fitted = least_squares.left_out_models(sums, ["g"], {"ridge": Linear(0.3)})
    found = least_squares.predicted(blocked, fitted, ["g"], ["end_date", "fold"]).collect()
    assert len(found) == len(table)
    by_key = {(r["g"], r["end_date"]): r for r in found}
    for g, day, fold, x, y in table:
        own = [r for r in table if r[0] == g and r[2] != fold]
        b = direct(np.array([r[3] for r in own]), np.array([r[4] for r in own]), 0.3)
        assert by_key[g, day]["y"] == y and np.allclose(by_key[g, day]["yhat"], np.array([1, *x]) @ b, atol=1e-6)


def test_validation_error_needs_no_rows(products, table):
    penalties = {f"p{p}": Linear(p) for p in (0.01, 0.1, 1.0, 10.0)}
    rows = least_squares.validated_models(products[1], ["g"], penalties, 0, 1).collect()
    for g in ("A", "B"):
        part = {f: [np.array([r[i] for r in table if r[0] == g and r[2] == f]) for i in (3, 4)] for f in (0, 1)}
        loss = {}
        for name, model in penalties.items():
            b = direct(*part[0], model.penalty)
            x, y = part[1]
            loss[name] = ((y - np.column_stack([np.ones(len(x)), x]) @ b) ** 2).mean()
        own = {r["model"]: r for r in rows if r["g"] == g}
        assert {n: r["loss"] for n, r in own.items()} == pytest.approx(loss, rel=1e-6)
        best = min(loss, key=loss.get)
        assert [n for n, r in own.items() if r["weights"] is not None] == [best]
        both = [np.concatenate([part[0][i], part[1][i]]) for i in (0, 1)]
        assert np.allclose(np.frombuffer(own[best]["weights"]).reshape(-1, 2), direct(*both, penalties[best].penalty), atol=1e-6)


def test_more_columns_than_rows(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(12, 30)), rng.normal(size=(12, 1))
    df = spark.createDataFrame([(0, START + dt.timedelta(days=i), 0, x[i].tolist(), y[i].tolist()) for i in range(12)],
                               "g int, end_date date, fold int, features array<double>, targets array<double>")
    blocked = least_squares.in_blocks(df, ["g"], "end_date")
    fitted = least_squares.left_out_models(least_squares.cross_products(blocked, ["g"]), ["g"], {"plain": Linear()})
    weights = [r for r in fitted.collect() if r["fold"] == -1]
    b = np.frombuffer(weights[0]["weights"]).reshape(-1, 1)
    assert np.allclose(np.column_stack([np.ones(12), x]) @ b, y, atol=1e-6)


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(6)
    rows = []
    for ticker, level in (("A", 0.2), ("B", 0.4)):
        v = level
        for i in range(200):
            v = level + 0.9 * (v - level) + 0.01 * rng.normal()
            rows.append((ticker, START + dt.timedelta(days=i), None if i == 37 else v, rng.normal(), int(i % 2)))
    return spark.createDataFrame(rows, "ticker string, date date, atm_iv double, skew double, regime int")


def test_window_sets_are_the_single_windows(daily):
    for chunk in (None, 50):
        sets = sequences.build_window_sets(daily, ["atm_iv", "skew"], "atm_iv", [5, 9], 3, chunk_rows=chunk)
        for w in (5, 9):
            single = sequences.build_sequences(daily, ["atm_iv", "skew"], "atm_iv", w, 3)
            own = sets.where(F.col("w") == w).drop("w")
            assert own.exceptAll(single).count() == 0 and single.exceptAll(own).count() == 0


def test_comparison_of_forecasts(spark, daily):
    built = forecasting.setup_sequences(daily, [5, 9], 3, regimes=(False, True), features=["atm_iv", "skew"], categories=[0, 1])
    assert {(r["w"], r["regime"]) for r in built.sequences.select("w", "regime").distinct().collect()} == {
        (w, g) for w in (5, 9) for g in (False, True)}
    few = {n: forecast.baseline_regressors()[n] for n in ("linear", "ridge", "decision_tree")}
    results, ranked = forecasting.run_grid(built, 3, (True, False), n_best=4, folds=3, models=few)
    assert results.count() == 2 * 4 * 2 * (len(few) + 1)
    for ticker in ("A", "B"):
        own = [r for r in ranked.collect() if r["ticker"] == ticker]
        every = sorted(r["mae"] for r in results.where(F.col("ticker") == ticker).collect())
        assert sorted(r["mae"] for r in own)[:4] == every[:4] and len(own) == 5
        weighted = min(r["mae"] for r in results.where((F.col("ticker") == ticker) & (F.col("model") == "EWMA")).collect())
        assert weighted in [r["mae"] for r in own if r["model"] == "EWMA"]
    # A ticker whose EWMA is among its best has it twice.
    assert forecasting.rank_grid(results.where("model = 'EWMA'"), 2).count() == 6

    found = forecasting.forecast_tickers(built)
    assert found.errors.count() == 2 and found.trials.where("chosen").count() == 2 * 4
    scale = {r["ticker"]: r for r in built.stats.collect()}
    truth = {(r["ticker"], r["date"]): r["atm_iv"] for r in daily.collect()}
    for row in found.predictions.collect():
        assert row["y"] == pytest.approx(truth[row["ticker"], row["end_date"] + dt.timedelta(days=row["horizon"])])
        assert abs(row["yhat"] - scale[row["ticker"]]["__target__mean"]) < 0.2
    errors = {r["ticker"]: r for r in found.errors.collect()}
    for ticker, e in errors.items():
        assert e["mae_units"] == pytest.approx(e["mae"] * scale[ticker]["__target__std"])
        assert 0 < e["mae_one_step"] < e["mae"] < e["rmse"] * 1.001
    table = forecasting.forecast_comparison(daily, [5], 3, folds=2, models=few, features=["atm_iv", "skew"]).collect()
    assert sorted((r["ticker"], r["model"].startswith("Traditional (")) for r in table) == [
        ("A", False), ("A", True), ("B", False), ("B", True)]


def test_no_windows_no_rows(daily):
    built = forecasting.setup_sequences(daily, [150], 60, features=["atm_iv", "skew"])
    assert built.sequences.count() == 0
    assert forecasting.run_grid(built, 60)[1].count() == 0 and forecasting.forecast_tickers(built).errors.count() == 0


def test_unfinished_runs_are_refused(spark, daily, tmp_path):
    windows = sequences.build_sequences(daily, ["atm_iv", "skew"], "atm_iv", 5, 2)
    run = forecast.direct_forecast(windows, {"kind": ["linear"], "depth": [2], "rounds": [5], "penalty": [0.1]}, 1)
    path = str(tmp_path / "run")
    sinks.save_run(run.model, run.predictions, path)
    saved = sinks.load_run(spark, path)
    assert saved.predictions.exceptAll(run.predictions).count() == 0
    assert forecast.predict_test(saved.model, windows).exceptAll(run.predictions).count() == 0
    (tmp_path / "run" / "manifest").rename(tmp_path / "elsewhere")
    with pytest.raises(FileNotFoundError):
        sinks.load_run(spark, path)


# --- many fits at once ---------------------------------------------------------------------------------


def test_fits_together_equal_fits_alone(spark, blobs, blob_frame):  # noqa: F811
    points = regimes.cluster_points(blob_frame, COLUMNS)
    starts = [lloyd.Start(k, seed) for k in (2, 3) for seed in (1, 2, 3)]
    together = lloyd.fit_many(points, starts)
    assert all(f.settled for f in together)
    for start, fit in zip(starts, together, strict=True):
        alone = lloyd.fit_many(points, [start])[0]
        assert np.allclose(alone.centres, fit.centres) and alone.inertia == pytest.approx(fit.inertia)
    x, which = blobs
    best = lloyd.best_fits(together, [range(0, 3), range(3, 6)])
    assert best[1].inertia == pytest.approx(sum(((x[which == c] - x[which == c].mean(0)) ** 2).sum() for c in range(3)))
    gaps = ((x[:, None] - best[0].centres[None]) ** 2).sum(-1)
    assert best[0].inertia == pytest.approx(gaps.min(1).sum())
    labels = lloyd.with_labels(points, [f.centres for f in best]).orderBy("date").collect()
    assert [r["labels"][0] for r in labels] == gaps.argmin(1).tolist()


def test_weights_are_repeated_rows(spark):
    x = [[0.0], [1.0], [10.0], [12.0]]
    points = spark.createDataFrame([(i, v, [float(n), 1.0]) for i, (v, n) in enumerate(zip(x, (3, 1, 2, 0)))],
                                   "place long, x array<double>, weights array<double>")
    weighted, plain = lloyd.fit_many(points, [lloyd.Start(2, 1, 0), lloyd.Start(2, 1)])
    assert sorted(weighted.centres.ravel()) == pytest.approx([0.25, 10.0]) and weighted.inertia == pytest.approx(0.75)
    assert sorted(plain.centres.ravel()) == pytest.approx([0.5, 11.0]) and plain.inertia == pytest.approx(2.5)
    with pytest.raises(ValueError):
        lloyd.fit_many(points.limit(0), [lloyd.Start(2, 1)])


def test_rand_index_matches_the_table_form(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in zip(rng.integers(0, 3, 60), rng.integers(0, 4, 60))]
    df = spark.createDataFrame(pairs, "a int, b int")
    cells = [(r["a"], r["b"], r["count"]) for r in df.groupBy("a", "b").count().collect()]
    assert lloyd.rand_index(cells) == pytest.approx(indices.adjusted_rand(df, "a", "b").first()[0])
    assert lloyd.rand_index([(0, 0, 5)]) == 1.0


@pytest.mark.parametrize("block_rows", [25, 4096])
def test_shared_indices_equal_single_ones(spark, blobs, block_rows):  # noqa: F811
    x, which = blobs
    other = (np.arange(150) % 4).tolist()
    df = spark.createDataFrame([(v.tolist(), int(a), int(b)) for v, a, b in zip(x, which, other)],
                               "features array<double>, one int, two int")
    found = {r["labeling"]: r["silhouette"] for r in indices.silhouettes(df, ["one", "two"], block_rows=block_rows).collect()}
    spread = indices.dispersion_indices(df, ["one", "two"])
    for name, labels in (("one", which), ("two", np.array(other))):
        assert found[name] == pytest.approx(brute_silhouette(x, labels), abs=1e-9)
        assert spread[name]["calinski_harabasz"] == pytest.approx(indices.calinski_harabasz(df, label=name).first()[0])
        assert spread[name]["davies_bouldin"] == pytest.approx(indices.davies_bouldin(df, label=name).first()[0])


def test_stability_of_a_sweep(blob_frame):  # noqa: F811
    rows = {r["k"]: r for r in regimes.k_sweep(blob_frame, COLUMNS, (2, 3), n_init=3, stability_runs=2).collect()}
    assert rows[3]["stability"] == pytest.approx(1.0) and rows[2]["stability"] <= 1.0
    alone = regimes.stability_bootstrap(blob_frame, COLUMNS, 3, 2, n_init=3)
    assert [r["adjusted_rand"] for r in alone.collect()] == pytest.approx([1.0, 1.0])
