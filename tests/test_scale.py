"""Groups cut into chunks, hot days, hot tickers and the plans that keep them spread."""

from __future__ import annotations

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.views import view
from volsmith.operators import clean, features, lags, quantiles, sequences
from volsmith.operators.chunks import positions, window_columns
from volsmith.session import stage
from volsmith.sources import scans, sinks


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def skewed(spark, n, one_day=False):
    """A third of the rows belong to one security, and optionally all of them to one day."""
    day = F.lit(0) if one_day else (F.col("id") * 7919 % 97).cast("int")
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 1.0).otherwise((F.col("id") % 11).cast("double"))
        .alias("secid"),
        F.date_add(F.lit("2020-01-01").cast("date"), day).alias("date"),
        (F.col("id") * 31 % 53).cast("double").alias("strike_price"),
        F.format_string("s%06d", "id").alias("symbol"),
        F.when(F.col("id") % 29 != 0, F.col("id") / 1000).alias("impl_volatility"),
        F.when(F.col("id") % 17 != 0, (F.col("id") * 13 % 1000).cast("double")).alias("prc"),
    )


@pytest.mark.parametrize("chunk_rows", [233, 300, 1000, 10**6])
@pytest.mark.parametrize("one_day", [False, True])
def test_chunks_equal_plain_windows(spark, chunk_rows, one_day):
    df = skewed(spark, 6000, one_day).persist()
    assert rows(lags.lead_target(df, chunk_rows=chunk_rows)) == rows(
        lags.lead_target(df, chunk_rows=None))
    assert rows(lags.price_differences(df, chunk_rows=chunk_rows)) == rows(
        lags.price_differences(df, chunk_rows=None))
    df.unpersist()


@pytest.mark.parametrize("one_day", [False, True])
def test_positions_equal_row_numbers(spark, one_day):
    df = skewed(spark, 4000, one_day).select("secid", "date", "strike_price", "symbol")
    spec = Window.partitionBy("secid").orderBy(*lags.QUOTE_ORDER)
    plain = df.withColumn("position", F.row_number().over(spec) - 1)
    assert rows(positions(df, ["secid"], lags.QUOTE_ORDER, chunk_rows=200)) == rows(plain)


def test_null_keys_stay_a_group_of_their_own(spark):
    df = skewed(spark, 900).withColumn(
        "secid", F.when(F.col("secid") != 5.0, F.col("secid"))).withColumn(
        "date", F.when(F.col("strike_price") > 3, F.col("date")))
    assert rows(lags.lead_target(df, 5, chunk_rows=50)) == rows(
        lags.lead_target(df, 5, chunk_rows=None))


def test_two_sided_windows(spark):
    df = skewed(spark, 3000)

    def around(w):
        return {"s": F.sum("strike_price").over(w.rowsBetween(-40, 25))}

    assert rows(window_columns(df, ["secid"], lags.QUOTE_ORDER, around, 40, 25, 100)) == rows(
        window_columns(df, ["secid"], lags.QUOTE_ORDER, around, chunk_rows=None))


def test_no_chunk_holds_a_whole_hot_group(spark):
    df = skewed(spark, 9000)
    sized = window_columns(
        df, ["secid"], lags.QUOTE_ORDER,
        lambda w: {"n": F.count(F.lit(1)).over(w.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))},
        before=10, after=10, chunk_rows=300)
    hot = df.where("secid = 1").count()
    assert hot > 3000
    assert sized.agg(F.max("n")).first()[0] < 700


def test_hot_day_is_divided(spark):
    df = skewed(spark, 9000, one_day=True)
    sized = window_columns(
        df, ["secid"], lags.QUOTE_ORDER,
        lambda w: {"n": F.count(F.lit(1)).over(w.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))},
        before=10, after=10, chunk_rows=300)
    assert sized.count() == 9000
    assert sized.agg(F.max("n")).first()[0] < 2500


def test_chunk_must_cover_the_reach(spark):
    with pytest.raises(ValueError):
        lags.lead_target(skewed(spark, 10), 30, chunk_rows=10)


def test_sequences_in_chunks(spark, sf):
    daily = view(spark, sf, "daily")
    args = (daily, ["atm_iv", "curvature"], "atm_iv", 12, 4)
    assert rows(sequences.build_sequences(*args, chunk_rows=50)) == rows(
        sequences.build_sequences(*args))


@pytest.mark.parametrize("accuracy", [50, 1000])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 0.999, 1.0])
def test_quantiles_beyond_the_sketch(spark, q, accuracy):
    rng = np.random.default_rng(7)
    values = {"a": rng.normal(size=4000), "b": np.round(rng.exponential(size=1500), 1),
              "c": np.array([5.0])}
    df = spark.createDataFrame(
        [(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    found = quantiles.exact_quantiles(
        df, "v", {"lin": (q, "linear"), "near": (q, "nearest")}, ["k"], accuracy)
    for row in found.collect():
        ordered = np.sort(values[row["k"]])
        assert row["lin"] == pytest.approx(np.quantile(ordered, q))
        assert row["near"] == ordered[int(np.floor((len(ordered) - 1) * q + 0.5))]


def test_thresholds_are_broadcast_only_while_small(spark, sf):
    quotes = view(spark, sf, "quotes")
    assert "BroadcastHashJoin" in plan_of(clean.volume_cap(quotes))
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        capped = clean.volume_cap(quotes)
        assert "BroadcastHashJoin" not in plan_of(capped)
        chunked = lags.lead_target(quotes, chunk_rows=500)
        assert "BroadcastHashJoin" not in plan_of(chunked)
        shuffled = rows(chunked.select("symbol", "iv_30d"))
        n_capped = capped.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
    assert n_capped == clean.volume_cap(quotes).count()
    assert shuffled == rows(lags.lead_target(quotes, chunk_rows=500).select("symbol", "iv_30d"))


def test_lags_share_one_sort(spark, sf):
    joined = view(spark, sf, "quotes").withColumn("prc", F.col("strike_price"))
    plan = plan_of(lags.price_differences(joined, chunk_rows=None))
    assert plan.count("(Sort)") + plan.count(") Sort") <= 2
    assert plan.count("Exchange") <= 4


def test_daily_features_hash_raw_rows(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(features, "stage", lambda df, name: (seen.append(plan_of(df)), stage(df, name))[1])
    features.daily_iv_features(view(spark, sf, "quotes"))
    tree = seen[0].split("\n\n")[0]
    assert "Sort" not in tree and tree.count("Exchange") == 1 and "HashAggregate" in tree


def test_scan_pushes_filters_and_columns(spark, sf, tmp_path):
    quotes = clean.add_date_parts(view(spark, sf, "quotes"))
    root = str(tmp_path / "quotes")
    sinks.write_quotes(quotes, root)
    stored = spark.read.parquet(root)
    assert stored.count() == quotes.count()
    plan = plan_of(scans.scan_quotes(spark, root, [1.0], "1994-01-01", "1994-12-31")
                   .select("symbol", "volume"))
    assert "GreaterThan(volume,0.0)" in plan and "EqualTo(secid,1.0)" in plan
    assert "GreaterThanOrEqual(date" in plan
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "impl_volatility" not in schema
    found, _ = scans.read_slice(spark, root, "T1", 1994, 1994)
    assert "PartitionFilters: [" in plan_of(found) and "ticker" in plan_of(found)


def test_top_n_is_cut_before_the_shuffle(spark, sf):
    from volsmith.operators.ranking import top_n_per_group

    plan = plan_of(top_n_per_group(view(spark, sf, "model_results"), "ticker", "mae", 2,
                                   ["run_id"]))
    assert "WindowGroupLimit" in plan


def test_staged_tables_go_to_the_checkpoint_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    staged = stage(spark.range(10), "probe")
    assert staged.count() == 10
    assert staged.inputFiles()[0].split("volsmith-")[0].rstrip("/").endswith(
        root.split("://")[-1].removeprefix("file:").rstrip("/"))
