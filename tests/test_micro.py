"""Edge cases on hand-made tables."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from volsmith.config import PipelineConfig
from volsmith.functions import arrays, scalar
from volsmith.operators import (
    charts, clean, features, forecast, indices, joins, lags, metrics, profile, quantiles, ranking,
    scaling, sequences,
)
from volsmith.sources import scans, schemas, sinks

DAY = dt.date(2023, 1, 2)
QUOTE = {
    "secid": 1.0, "ticker": "A", "date": DAY, "symbol": "s", "cp_flag": "C",
    "exdate": DAY + dt.timedelta(days=30), "strike_price": 100.0, "best_bid": 1.0,
    "best_offer": 1.2, "volume": 10.0, "open_interest": 5.0, "impl_volatility": 0.2, "delta": 0.5,
    "vega": 0.1, "theta": -0.1,
}
TYPES = ("secid double, ticker string, date date, symbol string, cp_flag string, exdate date, "
         "strike_price double, best_bid double, best_offer double, volume double, "
         "open_interest double, impl_volatility double, delta double, vega double, theta double")


def quotes(spark, *changes):
    rows = [tuple({**QUOTE, "symbol": f"s{i:03d}", **c}.values()) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, TYPES)


def kept(df):
    return sorted(r["symbol"] for r in df.collect())


def days(n, start=DAY):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_spread_boundary_is_strict(spark):
    df = quotes(spark, {"best_bid": 3.0, "best_offer": 5.0}, {"best_bid": 1.0, "best_offer": 1.6})
    assert kept(clean.liquidity_filter(df)) == ["s001"]


def test_bad_quotes_are_dropped(spark):
    df = quotes(
        spark, {"best_bid": 2.0, "best_offer": 1.9}, {"best_bid": 0.0}, {"best_bid": None},
        {"best_bid": math.nan}, {},
    )
    ingested = schemas.nan_to_null(df)
    assert ingested.where("best_bid is null").count() == 2
    assert kept(clean.liquidity_filter(ingested)) == ["s004"]


def test_volume_or_open_interest(spark):
    df = quotes(
        spark, {"volume": 0.0}, {"open_interest": 0.0}, {"volume": 0.0, "open_interest": 0.0},
        {"volume": None},
    )
    assert kept(clean.liquidity_filter(df)) == ["s000", "s001", "s003"]


def test_delta_edges(spark):
    df = quotes(spark, *[{"delta": d} for d in (0.05, -0.05, 0.95, -0.95, 0.04, 0.96)])
    assert kept(clean.liquidity_filter(df)) == ["s000", "s001", "s002", "s003"]


def test_tenor_edges(spark):
    df = quotes(spark, *[{"exdate": DAY + dt.timedelta(days=d)} for d in (24, 25, 90, 91)])
    assert kept(clean.tenor_filter(df)) == ["s001", "s002"]


def test_quantiles_of_eight_values(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 1, 4, 1, 5, 9, 2, 6)], "v double")
    assert quantiles.quantile_nearest(df, "v", 0.9).first()[0] == 6.0
    assert quantiles.quantile_linear(df, "v", 0.9).first()[0] == pytest.approx(6.9)


def test_quantile_ignores_nulls_and_keeps_empty_groups(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("a", 3.0), ("b", None), (None, 7.0)], "k string, v double"
    )
    found = {r[0]: r[1] for r in quantiles.quantile_linear(df, "v", 0.5, ["k"]).collect()}
    assert found == {"a": 2.0, "b": None, None: 7.0}


def test_winsorise_keeps_null(spark):
    df = quotes(spark, {"impl_volatility": None}, {"impl_volatility": 0.1},
                {"impl_volatility": 9.0})
    found = {r["symbol"]: r["impl_volatility"] for r in clean.winsorise(df, q=0.5).collect()}
    assert found["s000"] is None and found["s001"] == 0.1
    assert found["s002"] == pytest.approx(4.55)


def test_nearest_tie_takes_smaller_symbol_and_keeps_null(spark):
    tie = quotes(spark, {"delta": 0.6, "impl_volatility": 0.3},
                 {"delta": 0.4, "impl_volatility": 0.4})
    assert features.atm_iv(tie).first()["atm_iv"] == 0.3
    missing = quotes(spark, {"delta": 0.5, "impl_volatility": None}, {"delta": 0.9})
    assert features.atm_iv(missing).first()["atm_iv"] is None


def test_one_sided_and_single_row_groups(spark):
    row = features.daily_iv_features(quotes(spark, {})).first()
    assert row["atm_iv"] == 0.2
    assert row["skew"] is None and row["curvature"] is None and row["iv_std"] is None


@pytest.mark.parametrize("chunk_rows", [None, 40])
@pytest.mark.parametrize("rows, left", [(30, 0), (31, 1)])
def test_lead_at_the_end(spark, rows, left, chunk_rows):
    df = quotes(spark, *[{"date": d} for d in days(rows)])
    assert lags.lead_target(df, 30, chunk_rows=chunk_rows).count() == left


@pytest.mark.parametrize("chunk_rows", [None, 240])
@pytest.mark.parametrize("rows, left", [(233, 0), (234, 1)])
def test_price_lags_at_the_start(spark, rows, left, chunk_rows):
    df = quotes(spark, *[{"date": d} for d in days(rows)]).withColumn(
        "prc", F.dayofyear("date").cast("double"))
    found = lags.price_differences(df, chunk_rows=chunk_rows)
    assert found.count() == left
    if left:
        assert found.first()["price_diff_233d"] == pytest.approx(
            days(rows)[233].timetuple().tm_yday - days(rows)[0].timetuple().tm_yday)


def test_fibonacci_lags():
    assert scalar.fibonacci_lags(250) == [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233]
    assert scalar.fibonacci_lags(0) == []


@pytest.mark.parametrize("length, gap, count", [(6, None, 0), (7, None, 1), (7, 3, 0)])
def test_sequence_lengths(spark, length, gap, count):
    rows = [("A", d, None if i == gap else float(i)) for i, d in enumerate(days(length))]
    df = spark.createDataFrame(rows, "ticker string, date date, v double")
    assert sequences.build_sequences(df, ["v"], "v", 5, 2).count() == count


def test_sequence_content(spark):
    df = spark.createDataFrame(
        [("A", d, float(i), -float(i)) for i, d in enumerate(days(8))],
        "ticker string, date date, v double, w double")
    built = sequences.build_sequences(df, ["v", "w"], "v", 5, 2).orderBy("end_date").first()
    assert built["x"] == [[float(i), -float(i)] for i in range(5)]
    assert built["y"] == [5.0, 6.0] and built["end_date"] == days(5)[-1]


def test_ewma(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0])], "a array<double>, b array<double>")
    row = df.select(arrays.ewma("a", 0.3), arrays.ewma("b", 0.3)).first()
    assert row[0] == pytest.approx(1.81) and row[1] == 1.0


def test_split_counts(spark):
    df = spark.createDataFrame([("A", d) for d in days(7)], "ticker string, end_date date")
    found = sequences.time_series_split(df).groupBy("part").count().collect()
    assert {r[0]: r[1] for r in found} == {"train": 4, "validation": 1, "test": 2}


def test_global_split_puts_last_ticker_in_test(spark):
    df = spark.createDataFrame(
        [(t, d) for t in "AB" for d in days(5)], "ticker string, end_date date")
    found = sequences.time_series_split(df, mode="global").where("part = 'test'").collect()
    assert [r["ticker"] for r in found] == ["B", "B"]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(2.0,)] * 3, "v double")
    stats = scaling.fit_scaler(df, ["v"])
    assert [r[0] for r in scaling.standardise(df, ["v"], stats).collect()] == [0.0] * 3
    new = spark.createDataFrame([(3.0,)], "v double")
    assert scaling.standardise(new, ["v"], stats).first()[0] == 1.0


def test_adjusted_rand_edges(spark):
    same = spark.createDataFrame([(i % 3, (i + 1) % 3, 0) for i in range(9)], "a int, b int, c int")
    assert indices.adjusted_rand(same, "a", "a").first()[0] == 1.0
    assert indices.adjusted_rand(same, "a", "b").first()[0] == pytest.approx(1.0)
    assert indices.adjusted_rand(same, "c", "c").first()[0] == 1.0


def test_duplicate_names(spark):
    prices = spark.createDataFrame([("c", DAY, 1.0, 2.0)], "cusip string, date date, prc double, "
                                   "vol double")
    names = spark.createDataFrame([("c", "A"), ("c", "A")], "cusip string, ticker string")
    assert joins.join_names(prices, names).count() == 2
    assert joins.join_names(prices, names, dedupe=True).count() == 1


def test_missing_partition_is_reported(spark, tmp_path):
    rows = [("A", dt.date(y, 5, 1), float(y)) for y in (2022, 2024)]
    df = clean.add_date_parts(spark.createDataFrame(rows, "ticker string, date date, v double"))
    sinks.write_partitioned(df, str(tmp_path / "t"), ["ticker", "year"])
    found, missing = scans.read_slice(spark, str(tmp_path / "t"), "A", 2022, 2024)
    assert sorted(r["year"] for r in found.collect()) == [2022, 2024]
    assert [(r["ticker"], r["year"]) for r in missing.collect()] == [("A", 2023)]


def test_pivot_refuses_repeated_keys(spark):
    df = spark.createDataFrame([(DAY, "A", 1.0), (DAY, "A", 2.0)],
                               "date date, ticker string, v double")
    with pytest.raises(Exception, match="repeats"):
        profile.pivot_metric(df, "v", ["A"]).collect()


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "v double")
    found = {r["bin"]: r["n"] for r in charts.histogram(df, "v", 2).collect()}
    assert found == {0: 1, 1: 2}
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    row = charts.histogram(flat, "v", 50).first()
    assert (row["bin"], row["n"]) == (25, 2) and row["left_edge"] <= 3.0 <= row["right_edge"]


def test_density_integrates_to_one(spark):
    df = spark.range(2000).select((F.randn(1) * 2 + 5).alias("v"))
    curve = charts.density(df, "v", grid=400, overhang=3.0).orderBy("x").collect()
    step = curve[1]["x"] - curve[0]["x"]
    assert sum(r["density"] for r in curve) * step == pytest.approx(1.0, abs=0.01)


def test_top_rows(spark):
    df = spark.createDataFrame(
        [("A", "m1", 2.0), ("A", "m2", 1.0), ("A", "m3", None), ("B", "m1", 5.0)],
        "ticker string, model string, mae double")
    best = ranking.top_n_per_group(df, "ticker", "mae", 1, ["model"]).collect()
    assert sorted((r["ticker"], r["model"]) for r in best) == [("A", "m2"), ("B", "m1")]
    assert ranking.best_row(df, "mae").first()["model"] == "m2"


def test_setup_means_of_nothing_is_zero(spark):
    df = spark.createDataFrame(
        [("A", "kmeans", 0.5, [0.2, 0.4], []), ("A", "ward", 0.5, None, None)],
        "ticker string, method string, pca double, silhouettes array<double>, "
        "stabilities array<double>")
    found = {r["method"]: r for r in metrics.setup_means(df).collect()}
    assert found["kmeans"]["mean_silhouettes"] == pytest.approx(0.3)
    assert found["kmeans"]["mean_stabilities"] == 0.0
    assert found["ward"]["mean_silhouettes"] == 0.0


def test_compare_best_labels(spark):
    deep = spark.createDataFrame([("gbt", "A", 0.1)], "model string, ticker string, mae double")
    old = spark.createDataFrame([("linear", "A", 0.3), ("lasso", "A", 0.2)],
                                "model string, ticker string, mae double")
    found = {(r["model"], r["mae"]) for r in forecast.compare_best(deep, old).collect()}
    assert found == {("gbt", 0.1), ("Traditional (lasso)", 0.2)}


def test_metadata_round_trip(spark, tmp_path):
    raw = quotes(spark, {}, {"volume": 99.0})
    cut = clean.volume_thresholds(raw, 0.5)
    meta = sinks.run_metadata(raw, raw.limit(1), cut, PipelineConfig("2023-01-01", "2023-01-31"))
    sinks.write_metadata(meta, str(tmp_path / "m"))
    row = scans.read_metadata(spark, str(tmp_path / "m"), "A").first()
    assert row["data_statistics"]["total_records_raw"] == 2
    assert row["data_statistics"]["filter_retention_rate"] == 0.5
    assert row["data_statistics"]["years_available"] == [2023]
    assert row["schema"]["impl_volatility"] == "double"
    asked = spark.createDataFrame([("A",), ("Z",)], "ticker string")
    status = {r["ticker"]: r["status"] for r in sinks.run_summary(asked, meta).collect()}
    assert status == {"A": "success", "Z": "failed"}


def test_lags_by_day(spark):
    rows = [(1.0, "2024-01-01", 10.0, 0.1), (1.0, "2024-01-01", 10.0, 0.3), (1.0, "2024-01-02", None, 0.5),
            (1.0, "2024-01-04", 13.0, None), (1.0, "2024-01-05", 15.0, 0.7), (2.0, "2024-01-05", 1.0, 0.9)]
    df = spark.createDataFrame(rows, "secid double, date string, prc double, impl_volatility double").withColumn(
        "date", F.to_date("date")).withColumn("strike_price", F.lit(1.0)).withColumn("symbol", F.lit("s"))
    found = {(r["secid"], str(r["date"])): r for r in lags.price_differences(df, 3, unit="day", require=False).collect()}
    last = found[1.0, "2024-01-05"]
    assert (last["price_diff_1d"], last["price_diff_2d"], last["price_diff_3d"]) == (2.0, 5.0, 5.0)
    assert found[1.0, "2024-01-02"]["price_diff_1d"] is None and found[2.0, "2024-01-05"]["price_diff_1d"] is None
    assert lags.price_differences(df, 3, unit="day").count() == 2  # the days of 4 and 5 January
    ahead = {(r["secid"], str(r["date"])): r["iv_30d"] for r in lags.lead_target(df, 3, unit="day", require=False).collect()}
    assert ahead[1.0, "2024-01-01"] == 0.5 and ahead[1.0, "2024-01-02"] == 0.7
    assert ahead[1.0, "2024-01-04"] is None and ahead[2.0, "2024-01-05"] is None
    with pytest.raises(ValueError):
        lags.lead_target(df, unit="week")


def test_entry_survives_a_missing_library():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; assert 'ewma' in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
