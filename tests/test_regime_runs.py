"""Bootstrap stability from numbered rows: chunked numbers, one regime run, the sweep over set-ups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_statistics import COLUMNS, frame
from volsmith.operators import chunks, regimes
from volsmith.plans import regimes as plans


def two_blobs(spark, ticker="A", seed=3):
    rng = np.random.default_rng(seed)
    values = np.repeat([[0, 0, 0], [8, 0, 9.0]], [40, 30], axis=0) + rng.normal(size=(70, 3))
    return frame(spark, values, ticker)


@pytest.mark.parametrize("name", ["__all", "ticker"])
def test_positions_of_one_group_by_any_name(spark, name):
    df = spark.range(500).select(F.lit(0).alias(name), F.floor(F.col("id") / 100).alias("date"), "id")
    found = chunks.positions(df, [name], ["date", "id"], "position", 60)
    assert found.count() == 500 and found.where("position <> id").isEmpty()


def test_bootstrap_stability(spark):
    found = regimes.stability_bootstrap(two_blobs(spark), COLUMNS, 2, 2, n_init=2)
    assert [tuple(r) for r in found.collect()] == [(0, pytest.approx(1.0)), (1, pytest.approx(1.0))]


def test_regime_discovery_with_stability(spark):
    daily = two_blobs(spark).withColumnsRenamed({"a": "atm_iv", "b": "skew", "c": "curvature"})
    run = plans.regime_discovery(daily, "kmeans", 0.5, 2, runs=2, n_init=2)
    assert run.labelled.groupBy("regime").count().orderBy("regime").collect() == [(0, 40), (1, 30)]
    assert run.scores.first()["stability"] == pytest.approx(1.0)


def test_setup_sweep_has_every_set_up(spark):
    daily = two_blobs(spark).unionByName(two_blobs(spark, "B", 4)).withColumnsRenamed({"a": "atm_iv", "b": "skew", "c": "curvature"})
    scores, means = plans.setup_sweep(daily, ["A", "B"], shares=(0.0, 0.5), runs=2, n_init=2, ks=(2, 3))
    found = {(r["ticker"], r["method"], r["pca"], r["k"]): r["stability"] for r in scores.collect()}
    assert set(found) == {(t, m, s, k) for t in "AB" for m in ("kmeans", "ward") for s in (0.0, 0.5) for k in (2, 3)}
    assert all(found["A", "kmeans", s, 2] == pytest.approx(1.0) for s in (0.0, 0.5))
    assert means.count() == 8
