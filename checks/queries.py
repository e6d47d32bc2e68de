"""One query per operator, on whole tables; every callable takes (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.views import view
from volsmith.config import PipelineConfig
from volsmith.functions import arrays, scalar
from volsmith.operators.chunks import positions
from volsmith.operators import (
    charts, clean, features, forecast, indices, joins, lags, metrics, profile, quantiles, ranking,
    regimes, scaling, sequences, stationarity,
)
from volsmith.plans import extract, forecasting
from volsmith.plans import regimes as regime_plans
from volsmith.session import fit_side_by_side, stage, staging_root
from volsmith.sources import scans, schemas, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TICKERS = ["T0", "T1", "T2", "T3"]
FULL_RANGE = ("1990-01-01", "2010-12-31")
NUMERIC = ["atm_iv", "skew", "curvature"]
CENTRES = [[0.12, 0.5, 0.02], [0.15, 0.9, 0.08], [0.2, 0.7, 0.05]]
# Rows per chunk at the test scale, so that several chunks and their halos are exercised.
CHUNK = 5_000
# Half a unit in the last place would round differently in two engines; the shift moves such
# values off the half.
SHIFT = 1.37e-10


def register(name: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        return query

    return add


def rounded(df: DataFrame, places: int = 8) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[
        F.round(F.col(f.name) + F.lit(SHIFT), places).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema
    ])


def tradable(spark: SparkSession, sf: str) -> DataFrame:
    return clean.tenor_filter(clean.liquidity_filter(view(spark, sf, "quotes")))


# --- sources ------------------------------------------------------------------------------


@register("scan_quotes")
def _(spark, sf):
    master = view(spark, sf, "master")
    secids = scans.resolve_secids(master, ["T1", "T3"])
    found = scans.scan_quotes(
        spark, view(spark, sf, "quotes"), secids, "1994-01-01", "1996-12-31"
    )
    return rounded(found)


@register("scan_stock")
def _(spark, sf):
    return rounded(scans.scan_stock(
        spark, view(spark, sf, "stock_raw"), view(spark, sf, "names"), ["T1", "T2"],
        "1993-01-01", "1997-12-31",
    ))


@register("secid_lookup")
def _(spark, sf):
    return scans.resolve_secids(view(spark, sf, "master"), ["T1", "T2", "T9"])


@register("yearly_union")
def _(spark, sf):
    quotes = view(spark, sf, "quotes")
    root = f"{staging_root(spark)}/volsmith-{spark.sparkContext.applicationId}/years-{uuid.uuid4().hex}"
    quotes.withColumn("year", F.year("date")).write.partitionBy("year").parquet(root)
    found = sorted(r["year"] for r in spark.read.parquet(root).select("year").distinct().collect())
    years = [spark.read.schema(quotes.schema).parquet(f"{root}/year={y}") for y in found]
    stacked = scans.scan_yearly(
        spark, years, view(spark, sf, "master").distinct(), ["T0", "T2"], *FULL_RANGE
    )
    return rounded(stacked.select("ticker", "date", "symbol", "volume", "impl_volatility"))


@register("scan_rates")
def _(spark, sf):
    raw = view(spark, sf, "rates").withColumnRenamed("treasury_2y", "dgs2")
    return rounded(scans.scan_rates(spark, raw, "1994-01-01", "1995-12-31"))


@register("slice_rows")
def _(spark, sf):
    daily = clean.add_date_parts(view(spark, sf, "daily"))
    found, _ = scans.read_slice(spark, daily, "T1", 1994, 1995)
    return rounded(found)


@register("slice_missing")
def _(spark, sf):
    daily = clean.add_date_parts(view(spark, sf, "daily"))
    _, missing = scans.read_slice(spark, daily, ["T0", "T1", "T9"], 1990, 2003)
    return missing


@register("apply_schema")
def _(spark, sf):
    quotes = view(spark, sf, "quotes")
    as_text = quotes.select(*[F.col(c).cast("string").alias(c) for c in quotes.columns])
    broken = as_text.withColumn(
        "theta", F.when(F.col("cp_flag") == "P", "NaN").otherwise(F.col("theta"))
    )
    return rounded(schemas.apply_schema(broken, schemas.QUOTE_SCHEMA))


# --- projections and filters ----------------------------------------------------------------


@register("column_projection")
def _(spark, sf):
    chosen = clean.select_columns(view(spark, sf, "quotes"), ["symbol", "date", "strike_price"])
    return rounded(clean.annotate(clean.copy_column(chosen, "strike_price", "strike_copy"), w=60))


@register("date_parts")
def _(spark, sf):
    quotes = view(spark, sf, "quotes").select("symbol", F.col("date").cast("string").alias("date"))
    return clean.add_date_parts(clean.parse_dates(quotes, ["date"]))


@register("feature_selection")
def _(spark, sf):
    daily = clean.add_date_parts(view(spark, sf, "daily"))
    wide = daily.withColumns({"price_diff_1d": F.col("skew"), "price_diff_2d": F.col("skew")})
    trimmed = clean.trim_price_diffs(wide)
    chosen = clean.select_features(trimmed, ("date", "ticker", "year", "month", "day"))
    return rounded(clean.drop_columns(trimmed.select("date", "ticker", *chosen), "regime"))


@register("days_to_expiry")
def _(spark, sf):
    return clean.add_dte(view(spark, sf, "quotes")).select("symbol", "dte")


@register("predicates")
def _(spark, sf):
    quotes = view(spark, sf, "quotes")
    chosen = clean.where_in(quotes, "ticker", ["T0", "T3"])
    chosen = clean.where_range(chosen, "volume", 5.0, 25.0)
    return rounded(clean.where_present(chosen, "impl_volatility").select(
        "symbol", "ticker", "volume", "impl_volatility"))


@register("liquidity_filter")
def _(spark, sf):
    return rounded(clean.liquidity_filter(view(spark, sf, "quotes")).select(
        "symbol", "best_bid", "best_offer", "delta"))


@register("tenor_filter")
def _(spark, sf):
    return clean.tenor_filter(view(spark, sf, "quotes")).select("symbol", "date", "exdate", "dte")


@register("volume_cap")
def _(spark, sf):
    return rounded(clean.volume_cap(view(spark, sf, "quotes")).select(
        "symbol", "ticker", "volume"))


@register("winsorise_iv")
def _(spark, sf):
    return rounded(clean.winsorise(view(spark, sf, "quotes"), q=0.95).select(
        "symbol", "ticker", "impl_volatility"))


@register("one_hot")
def _(spark, sf):
    return clean.one_hot(
        view(spark, sf, "daily").select("ticker", "date", "regime"), "regime", [0, 1, 2]
    )


@register("sample_rows")
def _(spark, sf):
    return clean.sample_rows(view(spark, sf, "quotes").select("symbol", "ticker"), 20, ["symbol"])


# --- joins and unions -----------------------------------------------------------------------


@register("master_join")
def _(spark, sf):
    master = view(spark, sf, "master").distinct()
    joined = joins.join_master(view(spark, sf, "quotes"), master, ["T1", "T2"])
    return joined.select("symbol", "secid", "ticker")


@register("names_join")
def _(spark, sf):
    return rounded(joins.join_names(view(spark, sf, "stock_raw"), view(spark, sf, "names")))


@register("names_join_deduped")
def _(spark, sf):
    return rounded(joins.join_names(
        view(spark, sf, "stock_raw"), view(spark, sf, "names"), dedupe=True))


@register("quotes_join_stock")
def _(spark, sf):
    stock = view(spark, sf, "stock").withColumnRenamed("vol", "volume")
    joined = joins.join_stock(view(spark, sf, "quotes"), stock)
    return rounded(joined.select("symbol", "ticker", "date", "volume", "prc", "volume_stock"))


@register("rates_join")
def _(spark, sf):
    return rounded(joins.join_rates(view(spark, sf, "daily"), view(spark, sf, "rates")))


@register("label_join")
def _(spark, sf):
    daily = view(spark, sf, "daily")
    labels = daily.where(F.col("skew") > 0.5).select("ticker", "date", "regime")
    return rounded(joins.attach_labels(daily.drop("regime"), labels, ["ticker", "date"]))


@register("model_union")
def _(spark, sf):
    results = view(spark, sf, "model_results")
    deep = results.where(F.col("w") == 60).groupBy("model", "ticker").agg(
        F.min("mae").alias("mae"))
    return rounded(forecast.compare_best(deep, results.where(F.col("w") > 60)))


@register("result_union")
def _(spark, sf):
    results = view(spark, sf, "model_results")
    return rounded(joins.union_results(
        results.where(F.col("w") == 60), results.where(F.col("w") >= 60).drop("run_id")))


# --- profiles and aggregates ----------------------------------------------------------------


@register("distinct_values")
def _(spark, sf):
    return profile.distinct_values(view(spark, sf, "quotes"), ["ticker", "cp_flag"])


@register("value_counts")
def _(spark, sf):
    return profile.value_counts(view(spark, sf, "quotes"), "ticker")


@register("null_counts")
def _(spark, sf):
    return profile.null_counts(view(spark, sf, "quotes"))


@register("profile")
def _(spark, sf):
    return profile.profile(view(spark, sf, "daily"))


@register("retention")
def _(spark, sf):
    quotes = view(spark, sf, "quotes")
    return rounded(profile.retention(quotes, clean.liquidity_filter(quotes)))


@register("quantile_nearest")
def _(spark, sf):
    return rounded(quantiles.quantile_nearest(
        view(spark, sf, "quotes"), "strike_price", 0.9, ["ticker"]))


@register("quantile_linear")
def _(spark, sf):
    return rounded(quantiles.quantile_linear(
        view(spark, sf, "quotes"), "strike_price", 0.999, ["ticker"]))


@register("daily_iv_features")
def _(spark, sf):
    return rounded(features.daily_iv_features(tradable(spark, sf)))


@register("atm_iv")
def _(spark, sf):
    return rounded(features.atm_iv(view(spark, sf, "quotes")))


@register("wing_iv")
def _(spark, sf):
    return rounded(features.wing_iv(view(spark, sf, "quotes")))


@register("iv_std")
def _(spark, sf):
    return rounded(features.iv_std(view(spark, sf, "quotes")))


@register("regime_profile")
def _(spark, sf):
    return rounded(features.group_means(view(spark, sf, "daily"), ["regime"], NUMERIC))


@register("metric_pivot")
def _(spark, sf):
    return rounded(profile.pivot_metric(view(spark, sf, "daily"), "atm_iv", ["T0", "T1"]))


@register("metric_corr")
def _(spark, sf):
    wide = profile.pivot_metric(view(spark, sf, "daily"), "atm_iv", ["T0", "T1"])
    return rounded(profile.corr_matrix(wide, ["T0", "T1"]))


# --- windows and the extract ------------------------------------------------------------------


@register("lead_target")
def _(spark, sf):
    return rounded(lags.lead_target(view(spark, sf, "quotes"), chunk_rows=CHUNK).select(
        "symbol", "secid", "date", "iv_30d"))


@register("price_differences")
def _(spark, sf):
    joined = joins.join_stock(view(spark, sf, "quotes"), view(spark, sf, "stock"))
    found = lags.price_differences(joined, chunk_rows=CHUNK)
    return rounded(found.select(
        "symbol", "secid", "date", *[c for c in found.columns if c.startswith("price_diff_")]))


@register("lead_target_by_day")
def _(spark, sf):
    return rounded(lags.lead_target(view(spark, sf, "quotes"), unit="day").select("symbol", "secid", "date", "iv_30d"))


@register("price_differences_by_day")
def _(spark, sf):
    joined = joins.join_stock(view(spark, sf, "quotes"), view(spark, sf, "stock"))
    found = lags.price_differences(joined, unit="day")
    return rounded(found.select(
        "symbol", "secid", "date", *[c for c in found.columns if c.startswith("price_diff_")]))


def _extract(spark: SparkSession, sf: str, root: str | None = None) -> extract.ExtractRun:
    prices = view(spark, sf, "stock").withColumnRenamed("ticker", "cusip")
    names = prices.select("cusip", F.col("cusip").alias("ticker")).distinct()
    config = PipelineConfig(*FULL_RANGE, output_dir=root, chunk_rows=CHUNK)
    return extract.process_tickers(
        spark, [*TICKERS, "T9"], view(spark, sf, "quotes"), view(spark, sf, "master"), prices,
        names, config,
    )


@register("process_tickers")
def _(spark, sf):
    return rounded(_extract(spark, sf).cleaned.select(
        "ticker", "secid", "date", "symbol", "volume", "prc", "iv_30d", "price_diff_1d",
        "price_diff_233d", "year", "month", "day"))


@register("run_metadata")
def _(spark, sf):
    return rounded(_extract(spark, sf).metadata.select(
        "ticker", "data_statistics.volume_threshold", "data_statistics.total_records_raw",
        "data_statistics.total_records_written", "data_statistics.filter_retention_rate",
        F.array_join("data_statistics.years_available", ",").alias("years"),
    ))


@register("run_summary")
def _(spark, sf):
    return rounded(_extract(spark, sf).summary)


@register("write_read_quotes")
def _(spark, sf):
    root = f"{staging_root(spark)}/quotes-{uuid.uuid4().hex}"
    quotes = clean.add_date_parts(view(spark, sf, "quotes"))
    sinks.write_quotes(quotes, root)
    found, _ = scans.read_slice(spark, root, ["T1", "T2"], 1994, 1996)
    return rounded(found.select("ticker", "year", "date", "symbol", "volume", "impl_volatility"))


@register("write_read_features")
def _(spark, sf):
    root = f"{staging_root(spark)}/features-{uuid.uuid4().hex}"
    daily = view(spark, sf, "daily").withColumn("year", F.year("date"))
    sinks.write_partitioned(daily, f"{root}/by_year", ["ticker", "year"])
    sinks.write_table(scans.read_table(spark, f"{root}/by_year"), f"{root}/flat")
    return rounded(scans.read_table(spark, f"{root}/flat").select(
        "ticker", "year", "date", *NUMERIC, "regime"))


@register("extract_to_files")
def _(spark, sf):
    root = f"{staging_root(spark)}/extract-{uuid.uuid4().hex}"
    run = _extract(spark, sf, root)
    stored = run.cleaned.groupBy("ticker", "year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("iv_30d").alias("sum_iv"))
    status = run.summary.where("files_created > 0").select("ticker", "status", "records_written")
    return rounded(stored.join(status, "ticker"), 6)


@register("write_read_metadata")
def _(spark, sf):
    path = f"{staging_root(spark)}/metadata-{uuid.uuid4().hex}"
    quotes = view(spark, sf, "quotes")
    thresholds = clean.volume_thresholds(quotes)
    sinks.write_metadata(
        sinks.run_metadata(quotes, clean.liquidity_filter(quotes), thresholds,
                           PipelineConfig(*FULL_RANGE)), path)
    return rounded(scans.read_metadata(spark, path).select(
        "ticker", "data_statistics.total_records_raw", "data_statistics.total_records_written",
        F.size("schema").alias("n_columns"), "processing_config.batch_size"))


# --- sorts and top rows ---------------------------------------------------------------------------


@register("sorted_models")
def _(spark, sf):
    return rounded(ranking.sort(view(spark, sf, "model_results"), ["ticker", "mae", "run_id"]))


@register("first_dates")
def _(spark, sf):
    return rounded(ranking.first_n(
        view(spark, sf, "daily"), ["ticker", "regime"], ["date"], 3))


@register("head_rows")
def _(spark, sf):
    return clean.head(view(spark, sf, "quotes").select("symbol", "ticker"), 5, ["symbol"])


@register("top_models")
def _(spark, sf):
    return rounded(ranking.top_n_per_group(
        view(spark, sf, "model_results"), "ticker", "mae", 5, ["model", "w", "run_id"]))


@register("best_model")
def _(spark, sf):
    return rounded(ranking.best_row(view(spark, sf, "model_results"), "mae", ["run_id"]))


# --- scalar functions -------------------------------------------------------------------------------


@register("scalar_functions")
def _(spark, sf):
    quotes = view(spark, sf, "quotes")
    label = scalar.run_label("ticker", "cp_flag")
    return rounded(quotes.select(
        "symbol", scalar.mid_price().alias("mid"),
        F.when(scalar.mid_price() > 0, scalar.relative_spread()).alias("spread"),
        scalar.delta_distance(0.5, F.abs("delta")).alias("distance"),
        scalar.capped("impl_volatility", F.lit(0.25)).alias("capped"),
        scalar.days_between("exdate", "date").alias("days"),
        label.alias("label"),
    ).withColumns({"part": scalar.label_part("label", 1),
                   "named": scalar.traditional_label("label")}))


@register("json_round_trip")
def _(spark, sf):
    quotes = view(spark, sf, "quotes").select(
        "symbol", scalar.to_json_doc("ticker", "volume", "cp_flag").alias("doc"))
    parsed = scalar.from_json_doc("doc", "ticker string, volume double, cp_flag string")
    return quotes.select("symbol", parsed.alias("d")).select("symbol", "d.*")


@register("standardise")
def _(spark, sf):
    return rounded(scaling.standardise(view(spark, sf, "daily"), NUMERIC), 6)


@register("fit_scaler")
def _(spark, sf):
    return rounded(scaling.fit_scaler(view(spark, sf, "daily"), NUMERIC, ["ticker"]))


@register("inverse_scale")
def _(spark, sf):
    daily = view(spark, sf, "daily")
    stats = stage(scaling.fit_scaler(daily, ["atm_iv"]), "scaler")
    scaled = scaling.standardise(daily, ["atm_iv"], stats)
    return rounded(scaling.unscale(scaled, "atm_iv", stats).select("ticker", "date", "atm_iv"))


# --- sequences ---------------------------------------------------------------------------------------


def _windows(spark: SparkSession, sf: str, W: int = 60, H: int = 3, **kw) -> DataFrame:
    return sequences.build_sequences(
        view(spark, sf, "daily"), NUMERIC, "atm_iv", W, H, **kw)


def _sum2(x: str) -> Column:
    return F.aggregate(F.flatten(F.col(x)), F.lit(0.0), lambda a, v: a + v)


def _described(windows: DataFrame) -> DataFrame:
    return rounded(windows.select(
        "ticker", "end_date", F.size("x").alias("steps"),
        F.col("x")[0][0].alias("first_iv"), F.element_at("x", -1)[1].alias("last_skew"),
        _sum2("x").alias("total"), F.col("y")[0].alias("next_iv"),
        F.element_at("y", -1).alias("last_iv")), 6)


@register("sequences")
def _(spark, sf):
    return _described(_windows(spark, sf, chunk_rows=500))


@register("sequences_short")
def _(spark, sf):
    short = view(spark, sf, "short_series")
    return _described(sequences.build_sequences(short, ["atm_iv", "skew"], "atm_iv", 5, 2))


@register("sequences_too_long")
def _(spark, sf):
    short = view(spark, sf, "short_series")
    return _described(sequences.build_sequences(short, ["atm_iv", "skew"], "atm_iv", 60, 3))


@register("lookback_lookahead")
def _(spark, sf):
    daily = view(spark, sf, "daily")
    both = sequences.lookahead(sequences.lookback(daily, ["curvature"], 10), "curvature", 4)
    return rounded(both.select(
        "ticker", "date", F.size("x").alias("n_back"), F.size("y").alias("n_ahead"),
        _sum2("x").alias("sum_back")), 6)


def _forecasts(spark: SparkSession, sf: str) -> DataFrame:
    lean = _windows(spark, sf, collect=["atm_iv"])
    return sequences.ewma_forecast(lean, 0.3, repeat=3)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.explode_horizon(_forecasts(spark, sf), "y", "yhat")


@register("ewma")
def _(spark, sf):
    lean = _windows(spark, sf, collect=["atm_iv"])
    return rounded(sequences.ewma_forecast(lean, 0.3).select("ticker", "end_date", "yhat"))


@register("window_target")
def _(spark, sf):
    lean = _windows(spark, sf, collect=["atm_iv"])
    return rounded(lean.select(
        "ticker", "end_date", arrays.target("y", True).alias("mean_target"),
        arrays.target("y").alias("first_target"),
        F.size(arrays.flat_window("x")).alias("width")))


@register("ewma_eval")
def _(spark, sf):
    return rounded(metrics.eval_overall(_pairs(spark, sf), ["ticker"]))


@register("eval_by_horizon")
def _(spark, sf):
    return rounded(metrics.eval_by_horizon(_pairs(spark, sf), ["ticker"]))


@register("mean_path")
def _(spark, sf):
    return rounded(metrics.mean_path(_pairs(spark, sf), ["ticker"]))


@register("prediction_pairs")
def _(spark, sf):
    long = _pairs(spark, sf)
    return rounded(joins.pair_predictions(long.drop("yhat"), long.drop("y")))


@register("forecast_path")
def _(spark, sf):
    return rounded(sequences.forecast_path(_forecasts(spark, sf)))


@register("time_split")
def _(spark, sf):
    windows = _windows(spark, sf, collect=["atm_iv"]).select("ticker", "end_date")
    return sequences.time_series_split(windows)


@register("time_split_global")
def _(spark, sf):
    windows = _windows(spark, sf, collect=["atm_iv"]).select("ticker", "end_date")
    return sequences.time_series_split(windows, mode="global")


@register("row_positions")
def _(spark, sf):
    quotes = view(spark, sf, "quotes").select("secid", "date", "strike_price", "symbol")
    return rounded(positions(quotes, ["secid"], lags.QUOTE_ORDER, chunk_rows=CHUNK))


@register("regression_metrics")
def _(spark, sf):
    return rounded(_pairs(spark, sf).groupBy("ticker").agg(*metrics.regression_metrics()))


@register("setup_means")
def _(spark, sf):
    lists = view(spark, sf, "setup_runs").groupBy("ticker", "method", "pca").agg(
        F.collect_list("silhouette").alias("silhouettes"))
    return rounded(metrics.setup_means(lists, scores=["silhouettes"]))


# --- cluster indices, regimes, stationarity ----------------------------------------------------------


@register("calinski_harabasz")
def _(spark, sf):
    return rounded(indices.calinski_harabasz(view(spark, sf, "points"), "embedding"), 6)


@register("davies_bouldin")
def _(spark, sf):
    return rounded(indices.davies_bouldin(view(spark, sf, "points"), "embedding"), 6)


@register("silhouette")
def _(spark, sf):
    return rounded(indices.silhouette(view(spark, sf, "points"), "embedding"), 6)


@register("silhouette_sq")
def _(spark, sf):
    score = indices.silhouette_sq(view(spark, sf, "points"), "embedding")
    return rounded(spark.createDataFrame([(score,)], "silhouette_sq double"), 6)


@register("adjusted_rand")
def _(spark, sf):
    return rounded(indices.adjusted_rand(view(spark, sf, "points"), "label", "other"))


@register("kmeans_assign")
def _(spark, sf):
    complete = clean.where_present(view(spark, sf, "daily"), *NUMERIC).drop("regime")
    return rounded(regimes.assign_to_centres(complete, NUMERIC, CENTRES))


def _scaled_daily(spark: SparkSession, sf: str) -> DataFrame:
    daily = clean.where_present(view(spark, sf, "daily").drop("regime"), *NUMERIC)
    return stage(scaling.standardise(daily, NUMERIC), "scaled-daily")


@register("kmeans_regimes")
def _(spark, sf):
    return regimes.kmeans(_scaled_daily(spark, sf), NUMERIC, 3).labelled


@register("k_sweep")
def _(spark, sf):
    return regimes.k_sweep(_scaled_daily(spark, sf), NUMERIC)


@register("pca_by_variance")
def _(spark, sf):
    parts = regimes.pca_by_variance(_scaled_daily(spark, sf), NUMERIC, 0.7)
    return parts.scored


@register("top_loadings")
def _(spark, sf):
    parts = regimes.pca_by_variance(_scaled_daily(spark, sf), NUMERIC, 0.7)
    return regimes.top_loadings(parts.loadings)


@register("pca_two_columns")
def _(spark, sf):
    pair = ["atm_iv", "skew"]
    loadings = regimes.pca_by_variance(_scaled_daily(spark, sf), pair, 1.0).loadings
    of = {c: F.max(F.when(F.col("feature") == c, F.col("loading"))) for c in pair}
    # Both loadings of a component weigh the same here, so only their product has a sign.
    return rounded(loadings.groupBy("component").agg(
        F.max("ratio").alias("ratio"), (of["atm_iv"] * of["skew"]).alias("product")))


@register("top_loadings_of_table")
def _(spark, sf):
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet")
    loadings = suppliers.select((F.col("s_nationkey") % 5).cast("int").alias("component"), F.col("s_name").alias("feature"),
                                F.col("s_acctbal").cast("double").alias("loading"))
    return rounded(regimes.top_loadings(loadings))


@register("ward_clusters")
def _(spark, sf):
    return regimes.ward_clusters(_scaled_daily(spark, sf), NUMERIC, 3).labelled


@register("ward_tree")
def _(spark, sf):
    fitted = regimes.ward_clusters(_scaled_daily(spark, sf), NUMERIC, 3)
    return regimes.truncated_tree(fitted.merges)


@register("stability_subsample")
def _(spark, sf):
    return regimes.stability_subsample(_scaled_daily(spark, sf), NUMERIC, 3)


@register("stability_bootstrap")
def _(spark, sf):
    return regimes.stability_bootstrap(_scaled_daily(spark, sf), NUMERIC, 3)


def _each_ticker(spark: SparkSession, sf: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Regimes are found within a ticker: one run for each ticker of the table, side by side."""
    daily = view(spark, sf, "daily")
    tickers = sorted(r[0] for r in daily.select("ticker").distinct().collect())
    found = fit_side_by_side(spark, lambda t: run(daily.where(F.col("ticker") == t)), tickers)
    return joins.union_results(*found)


@register("regime_discovery")
def _(spark, sf):
    return _each_ticker(spark, sf, lambda own: regime_plans.regime_discovery(own, "kmeans", 0.5, 3).labelled)


@register("regime_discovery_days")
def _(spark, sf):
    found = _each_ticker(spark, sf, lambda own: regime_plans.regime_discovery(
        own, "kmeans", 0.5, 3, stability=False).labelled)
    return rounded(found.withColumn("labelled", F.col("regime").between(0, 2)).drop("regime"))


@register("setup_sweep")
def _(spark, sf):
    daily = view(spark, sf, "daily")
    tickers = sorted(r[0] for r in daily.select("ticker").distinct().collect())
    return regime_plans.setup_sweep(daily, tickers)[1]


@register("silhouettes")
def _(spark, sf):
    return rounded(indices.silhouettes(view(spark, sf, "points"), ["label", "other"], "embedding"), 6)


@register("adf_lag0")
def _(spark, sf):
    return rounded(stationarity.adf(view(spark, sf, "daily"), "atm_iv", max_lag=0).select(
        "ticker", "adf_stat", "n_obs"), 6)


@register("adf")
def _(spark, sf):
    return stationarity.adf(view(spark, sf, "daily"), "atm_iv")


# --- charts --------------------------------------------------------------------------------------------


@register("histogram")
def _(spark, sf):
    return rounded(charts.histogram(view(spark, sf, "quotes"), "strike_price", by=["ticker"]), 6)


@register("kde")
def _(spark, sf):
    return rounded(charts.density(view(spark, sf, "quotes"), "strike_price", by=["ticker"]), 9)


@register("box_stats")
def _(spark, sf):
    return rounded(charts.box_stats(view(spark, sf, "quotes"), "strike_price"))


@register("line_points")
def _(spark, sf):
    return rounded(charts.line_points(
        view(spark, sf, "quotes"), "date", "impl_volatility", "ticker"))


@register("pair_bins")
def _(spark, sf):
    return charts.pair_bins(view(spark, sf, "daily"), NUMERIC, "regime")


@register("regime_timeline")
def _(spark, sf):
    return rounded(charts.regime_timeline(view(spark, sf, "daily")))


@register("regime_runs")
def _(spark, sf):
    return charts.regime_runs(view(spark, sf, "daily"))


# --- forecasts -------------------------------------------------------------------------------------------


@register("feature_extraction")
def _(spark, sf):
    daily = joins.join_rates(view(spark, sf, "daily"), view(spark, sf, "rates"))
    filled = daily.withColumn("treasury_2y", F.coalesce("treasury_2y", F.lit(1.0)))
    return rounded(forecasting.feature_extraction(
        filled, rates=True, regime=True, W=20, H=5, features=NUMERIC, categories=[0, 1, 2],
    ).select("ticker", "end_date", F.size(F.col("x")[0]).alias("width"),
             F.element_at("x", -1)[0].alias("last_iv"), F.element_at("x", -1)[3].alias("last_rate"),
             F.element_at("x", -1)[4].alias("is_regime_0"), F.col("y")[4].alias("last_target")), 6)


@register("compare_regressors")
def _(spark, sf):
    windows = stage(_windows(spark, sf), "windows")
    return forecast.compare_regressors(windows)


@register("ewma_baseline_row")
def _(spark, sf):
    windows = stage(_windows(spark, sf), "windows")
    return rounded(forecast.compare_regressors(windows).where("model = 'EWMA'"))


@register("direct_forecast")
def _(spark, sf):
    windows = stage(_windows(spark, sf), "windows")
    return forecast.direct_forecast(windows).predictions


@register("grouped_ridge")
def _(spark, sf):
    steps = sequences.build_sequences(view(spark, sf, "daily"), ["atm_iv", "skew"], "atm_iv", 1, 2)
    found = forecast.forecast_by_group(steps, penalties=[0.1], inputs=["flat"])
    return rounded(forecast.forecast_errors(found.predictions, ["ticker", "horizon"]).drop("mae_one_step"))


@register("window_sets")
def _(spark, sf):
    sets = sequences.build_window_sets(view(spark, sf, "daily"), NUMERIC, "atm_iv", [5, 20], 3)
    return rounded(sets.select("ticker", "end_date", "w", F.size("x").alias("steps"), F.col("x")[0][0].alias("first_iv"),
                               F.element_at("x", -1)[1].alias("last_skew"), F.col("y")[2].alias("last_target")))


def _setups(spark: SparkSession, sf: str) -> forecasting.SetupSequences:
    return forecasting.setup_sequences(view(spark, sf, "daily"), features=NUMERIC)


@register("ticker_forecasts")
def _(spark, sf):
    return forecasting.forecast_tickers(_setups(spark, sf)).predictions


@register("ticker_forecast_errors")
def _(spark, sf):
    return forecasting.forecast_tickers(_setups(spark, sf)).errors


@register("forecast_comparison")
def _(spark, sf):
    return forecasting.forecast_comparison(view(spark, sf, "daily"), features=NUMERIC)


@register("saved_model")
def _(spark, sf):
    windows = stage(_windows(spark, sf), "windows")
    run = forecast.direct_forecast(windows)
    path = f"{staging_root(spark)}/model-{uuid.uuid4().hex}"
    sinks.save_run(run.model, run.predictions, path)
    saved = sinks.load_run(spark, path)
    again = forecast.predict_test(saved.model, windows).withColumnRenamed("yhat", "again").drop("y")
    return saved.predictions.join(again, ["ticker", "end_date", "horizon"]).select(
        "ticker", "end_date", "horizon", "y", "yhat", (F.col("yhat") == F.col("again")).alias("same"))


@register("experiment_grid")
def _(spark, sf):
    return forecasting.run_grid(_setups(spark, sf))[1]
