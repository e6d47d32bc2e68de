"""Statistical and learning operators against direct computations and their properties."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from volsmith.operators import charts, forecast, indices, metrics, regimes, scaling, sequences
from volsmith.operators.stationarity import adf, mackinnon_p
from volsmith.plans import forecasting
from volsmith.plans import regimes as plans
from volsmith.sources import sinks

START = dt.date(2020, 1, 1)
COLUMNS = ["a", "b", "c"]


def frame(spark, values, ticker="A"):
    rows = [(ticker, START + dt.timedelta(days=i), *map(float, v)) for i, v in enumerate(values)]
    names = ["a", "b", "c", "d", "e"][: values.shape[1]]
    return spark.createDataFrame(
        rows, "ticker string, date date, " + ", ".join(f"{n} double" for n in names))


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0, 0], [6, 0, 1], [0, 7, -2.0]])
    which = np.repeat([0, 1, 2], [60, 50, 40])
    return centres[which] + rng.normal(size=(150, 3)), which


@pytest.fixture(scope="module")
def blob_frame(spark, blobs):
    return frame(spark, blobs[0]).persist()


def distances(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))


def brute_silhouette(x, labels):
    gaps, scores = distances(x), []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = gaps[i, own].sum() / (own.sum() - 1)
        b = min(gaps[i, labels == k].mean() for k in set(labels) - {labels[i]})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


@pytest.mark.parametrize("block_rows", [2048, 20])
def test_silhouette_with_a_lone_point(spark, blobs, block_rows):
    x, which = blobs
    labels = which.copy()
    labels[0] = 9
    df = spark.createDataFrame(
        [(v.tolist(), int(k)) for v, k in zip(x, labels)], "features array<double>, label int")
    found = indices.silhouette(df, block_rows=block_rows).first()[0]
    assert found == pytest.approx(brute_silhouette(x, labels), abs=1e-9)


def test_indices_do_not_depend_on_label_names(spark, blobs):
    x, which = blobs
    swapped = np.array([2, 0, 1])[which]
    df = spark.createDataFrame(
        [(v.tolist(), int(k), int(s)) for v, k, s in zip(x, which, swapped)],
        "features array<double>, label int, other int")
    for index in (indices.silhouette, indices.calinski_harabasz, indices.davies_bouldin):
        assert index(df, label="label").first()[0] == pytest.approx(
            index(df, label="other").first()[0])
    assert indices.adjusted_rand(df, "label", "other").first()[0] == pytest.approx(1.0)
    assert indices.silhouette_sq(df) > 0.5


def test_weighted_adjusted_rand_equals_repeated_rows(spark):
    rows = [(0, 0, 2.0), (0, 1, 1.0), (1, 1, 3.0), (1, 0, 1.0)]
    df = spark.createDataFrame(rows, "a int, b int, w double")
    repeated = spark.createDataFrame(
        [(a, b) for a, b, w in rows for _ in range(int(w))], "a int, b int")
    assert indices.adjusted_rand(df, "a", "b", "w").first()[0] == pytest.approx(
        indices.adjusted_rand(repeated, "a", "b").first()[0])


def test_kmeans_finds_blobs_and_orders_labels(blobs, blob_frame):
    run = regimes.kmeans(blob_frame, COLUMNS, 3, n_init=3, order_by="b")
    rows = run.labelled.orderBy("date").collect()
    labels = np.array([r["regime"] for r in rows])
    x, which = blobs
    assert all(len(set(labels[which == k])) == 1 for k in range(3))
    means = [x[labels == k, 1].mean() for k in range(3)]
    assert means == sorted(means)
    inertia = sum(((x[labels == k] - x[labels == k].mean(0)) ** 2).sum() for k in range(3))
    assert run.inertia == pytest.approx(inertia, rel=1e-6)


def test_sweep_inertia_falls_with_k(blob_frame):
    rows = regimes.k_sweep(blob_frame, COLUMNS, (2, 3, 4), n_init=4).orderBy("k").collect()
    inertia = [r["inertia"] for r in rows]
    assert inertia[0] >= inertia[1] >= inertia[2] * 0.999
    assert max(rows, key=lambda r: r["silhouette"])["k"] == 3


def test_pca_matches_svd(blobs, blob_frame):
    scaled = scaling.standardise(blob_frame, COLUMNS)
    x = blobs[0]
    z = (x - x.mean(0)) / x.std(0)
    ratios = np.linalg.svd(z, compute_uv=False) ** 2
    ratios = ratios / ratios.sum()
    whole = regimes.pca_by_variance(scaled, COLUMNS, 1.0)
    assert len(whole.columns) == 3
    got = {r["component"]: r["ratio"] for r in whole.loadings.collect()}
    assert sum(got.values()) == pytest.approx(1.0)
    assert [got[i + 1] for i in range(3)] == pytest.approx(list(ratios))
    part = regimes.pca_by_variance(scaled, COLUMNS, ratios[0] + 1e-6)
    assert part.columns == ["pc1", "pc2"]
    top = regimes.top_loadings(part.loadings, 1).collect()
    assert all(r["loading"] > 0 for r in top)
    assert regimes.pca_by_variance(scaled, COLUMNS, 0.0).columns == COLUMNS


def naive_ward(x, k):
    """Merge whichever two groups of rows raise the squared error least."""
    groups = [[i] for i in range(len(x))]

    def error(g):
        return ((x[g] - x[g].mean(0)) ** 2).sum()

    while len(groups) > k:
        best = min(
            ((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))),
            key=lambda p: error(groups[p[0]] + groups[p[1]]) - error(groups[p[0]])
            - error(groups[p[1]]),
        )
        merged = groups[best[0]] + groups[best[1]]
        groups = [g for n, g in enumerate(groups) if n not in best] + [merged]
    labels = np.empty(len(x), int)
    for n, g in enumerate(groups):
        labels[g] = n
    return labels


@pytest.mark.parametrize("k", [2, 3, 5])
def test_ward_equals_naive_ward(spark, k):
    x = np.random.default_rng(k).normal(size=(30, 2))
    df = frame(spark, x)
    fitted = regimes.ward_cut(regimes.ward_exact_tree(df, ["a", "b"]), k, "a")
    labels = [r["regime"] for r in fitted.labelled.orderBy("date").collect()]
    pairs = spark.createDataFrame(
        [(int(p), int(q)) for p, q in zip(labels, naive_ward(x, k))], "a int, b int")
    assert indices.adjusted_rand(pairs, "a", "b").first()[0] == pytest.approx(1.0)
    heights = [r["height"] for r in fitted.merges.orderBy("step").collect()]
    assert len(heights) == 29 and heights == sorted(heights)
    assert fitted.merges.agg(F.max("size")).first()[0] == 30
    assert regimes.truncated_tree(fitted.merges).count() == 11


def test_ward_condensed_finds_blobs(blobs, blob_frame):
    fitted = regimes.ward_clusters(blob_frame, COLUMNS, 3, micro=20)
    labels = np.array([r["regime"] for r in fitted.labelled.orderBy("date").collect()])
    assert all(len(set(labels[blobs[1] == k])) == 1 for k in range(3))


def test_stability_of_clear_blobs(blob_frame):
    for method in ("kmeans", "ward"):
        scores = regimes.stability_subsample(blob_frame, COLUMNS, 3, 2, method=method, n_init=2)
        assert [r["adjusted_rand"] for r in scores.collect()] == pytest.approx([1.0, 1.0])
    scores = regimes.stability_bootstrap(blob_frame, COLUMNS, 3, 2, n_init=2)
    assert [r["adjusted_rand"] for r in scores.collect()] == pytest.approx([1.0, 1.0])


def test_samples_have_their_size(blob_frame):
    assert regimes.sample_exactly(blob_frame, ["ticker", "date"], 0.8, 5).count() == 120
    drawn = regimes.bootstrap_counts(regimes.bootstrap_index(blob_frame, ["ticker", "date"]), 5)
    assert drawn.agg(F.sum("__weight")).first()[0] == 150.0
    assert 80 < drawn.count() < 115


def direct_adf(y, max_lag=None):
    """Ordinary least squares on explicitly built regressors."""
    n = len(y)
    if max_lag is None:
        max_lag = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    step = np.diff(y)

    def fit(lags, skip):
        t = np.arange(skip, len(step))
        x = np.column_stack([np.ones(len(t)), y[t], *[step[t - i] for i in range(1, lags + 1)]])
        beta = np.linalg.lstsq(x, step[t], rcond=None)[0]
        ssr = ((step[t] - x @ beta) ** 2).sum()
        m = len(t)
        aic = m * (math.log(2 * math.pi) + math.log(ssr / m) + 1) + 2 * x.shape[1]
        error = math.sqrt(ssr / (m - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        return beta[1] / error, aic, m

    lag = min(range(max_lag + 1), key=lambda p: fit(p, max_lag)[1])
    tau, _, m = fit(lag, lag)
    return tau, lag, m


def test_adf_equals_direct_regression(spark):
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.normal(size=300))
    mean_reverting = np.zeros(180)
    for i in range(1, 180):
        mean_reverting[i] = 0.5 * mean_reverting[i - 1] + rng.normal()
        if i > 3:
            mean_reverting[i] += 0.3 * mean_reverting[i - 3]
    rows = [(t, START + dt.timedelta(days=i), float(v))
            for t, s in (("W", walk), ("M", mean_reverting)) for i, v in enumerate(s)]
    rows += [("W", START - dt.timedelta(days=1), None), ("S", START, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, v double")
    found = {r["ticker"]: r for r in adf(df, "v").collect()}
    for ticker, series in (("W", walk), ("M", mean_reverting)):
        tau, lag, n = direct_adf(series)
        assert found[ticker]["adf_stat"] == pytest.approx(tau, rel=1e-6)
        assert (found[ticker]["used_lag"], found[ticker]["n_obs"]) == (lag, n)
    chunked = {r["ticker"]: r for r in adf(df, "v", chunk_rows=40).collect()}
    for ticker, row in found.items():
        assert tuple(chunked[ticker])[3:5] == tuple(row)[3:5]
        assert row["adf_stat"] is None or chunked[ticker]["adf_stat"] == pytest.approx(row["adf_stat"], rel=1e-9)
    assert found["W"]["p_value"] > 0.05
    assert found["S"]["adf_stat"] is None


def test_p_values():
    # Published 5% and 1% points of the distribution with a constant.
    assert mackinnon_p(-2.86) == pytest.approx(0.05, abs=0.002)
    assert mackinnon_p(-3.43) == pytest.approx(0.01, abs=0.001)
    assert mackinnon_p(3.0) == 1.0 and mackinnon_p(-20.0) == 0.0


def test_density_matches_direct_sum(spark):
    values = np.random.default_rng(2).gamma(2.0, size=500)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    curve = charts.density(df, "v", grid=50, overhang=3.0).collect()
    width = values.std(ddof=1) * len(values) ** -0.2
    for row in curve:
        z = (row["x"] - values) / width
        direct = np.exp(-z * z / 2).mean() / (width * math.sqrt(2 * math.pi))
        assert row["density"] == pytest.approx(direct, abs=2e-4)


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for ticker in ("A", "B"):
        level = 0.2
        for i in range(160):
            level = 0.2 + 0.9 * (level - 0.2) + 0.01 * rng.normal()
            rows.append((ticker, START + dt.timedelta(days=i), level, rng.normal()))
    df = spark.createDataFrame(rows, "ticker string, date date, atm_iv double, skew double")
    return sequences.build_sequences(df, ["atm_iv", "skew"], "atm_iv", 20, 3).persist()


def test_compare_regressors(windows):
    few = {n: forecast.baseline_regressors()[n] for n in ("linear", "lasso", "decision_tree")}
    first = forecast.compare_regressors(windows, folds=3, models=few, n_best=2).collect()
    assert len(first) == 3 and first[-1]["model"] == "EWMA"
    assert first[0]["cv_mae"] <= first[1]["cv_mae"]
    assert all(r["rmse"] == pytest.approx(math.sqrt(r["mse"])) for r in first)
    again = forecast.compare_regressors(windows, folds=3, models=few, n_best=2).collect()
    assert [tuple(r) for r in first] == [tuple(r) for r in again]


def test_compare_regressors_of_nothing(windows):
    assert forecast.compare_regressors(windows.where("ticker = 'Z'")).count() == 0


def test_direct_forecast(spark, windows, tmp_path):
    run = forecast.direct_forecast(windows, max_trials=2)
    assert run.trials.count() == 2
    test_rows = sequences.time_series_split(windows).where("part = 'test'").count()
    assert run.predictions.count() == 3 * test_rows
    by_step = metrics.eval_by_horizon(run.predictions, ["ticker"])
    assert by_step.count() == 6
    overall = metrics.eval_overall(run.predictions).first()
    assert 0 < overall["mae"] < 0.1
    sinks.save_model(run.model, str(tmp_path / "model"))
    loaded = type(run.model).load(str(tmp_path / "model"))
    assert loaded.uid == run.model.uid


def test_regime_discovery_plan(spark, blobs):
    daily = frame(spark, np.column_stack([blobs[0], blobs[0][:, 0]])).withColumnsRenamed(
        {"a": "atm_iv", "b": "skew", "c": "curvature", "d": "iv_std"})
    holed = daily.withColumn("skew", F.when(F.col("date") != START, F.col("skew")))
    run = plans.regime_discovery(holed, "kmeans", 0.9, 3, stability=False, n_init=2)
    assert run.n_incomplete == 1 and run.labelled.count() == 149
    assert run.scores.first()["silhouette"] > 0.4
    ward = plans.regime_discovery(holed, "ward", 0.0, 3, stability=False)
    assert ward.scores.first()["silhouette"] > 0.4
    with pytest.raises(ValueError):
        plans.regime_discovery(holed, "other")


def test_scaling_on_training_days_only(spark):
    rows = [("A", START + dt.timedelta(days=i), float(i)) for i in range(20)]
    daily = spark.createDataFrame(rows, "ticker string, date date, atm_iv double")
    built = forecasting.feature_extraction(daily, W=3, H=1, fit_on="train", features=["atm_iv"])
    first = built.orderBy("end_date").first()
    early = np.arange(12.0)
    assert first["x"][0][0] == pytest.approx((0 - early.mean()) / early.std())
