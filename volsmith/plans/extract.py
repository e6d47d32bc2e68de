"""From raw quotes and prices to cleaned, partitioned quotes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession

from volsmith.config import PipelineConfig
from volsmith.operators.clean import add_date_parts, volume_cap, volume_thresholds
from volsmith.operators.joins import join_master, join_stock
from volsmith.operators.lags import target_and_differences
from volsmith.session import stage
from volsmith.sources import scans, sinks


@dataclass
class ExtractRun:
    """Cleaned quotes, one metadata document per ticker and one status row per asked ticker."""

    cleaned: DataFrame
    metadata: DataFrame
    summary: DataFrame


def apply_transformations(
    quotes: DataFrame, config: PipelineConfig,
) -> tuple[DataFrame, DataFrame]:
    """Volume cap, forward target, price differences and date parts.

    Lags count the rows the earlier filters left. Target and differences share one shuffle of the quotes.
    """
    thresholds = stage(volume_thresholds(quotes, config.volume_quantile), "thresholds")
    capped = volume_cap(quotes, thresholds=thresholds)
    found = target_and_differences(
        capped, config.lead_rows, config.max_price_lag, chunk_rows=config.chunk_rows
    )
    # The date parts follow from the date, so they are added after the shuffle.
    parts = add_date_parts(found)
    given, added = capped.columns, [c for c in parts.columns if c not in found.columns]
    new = [c for c in found.columns if c not in given]
    return parts.select(*given, *added, *new), thresholds


def process_tickers(
    spark: SparkSession, tickers: Iterable[str], quotes: str | DataFrame, master: DataFrame,
    prices: str | DataFrame, names: str | DataFrame, config: PipelineConfig,
) -> ExtractRun:
    """All tickers in one job. A ticker that yields nothing is a status row, not an error.

    With an ``output_dir`` quotes and metadata are written there and read back. Rows and years are
    counted by the writes themselves, for each asked ticker, so no table is read again for the metadata.
    """
    tickers = list(tickers)
    secids = scans.resolve_secids(master, tickers)
    raw = join_master(
        scans.scan_quotes(spark, quotes, secids, config.from_date, config.to_date), secids, tickers
    )
    # A row per ticker and day: staged, so that its size is known and the quotes need no shuffle to meet it.
    stock = stage(scans.scan_stock(
        spark, prices, names, tickers, config.from_date, config.to_date, config.dedupe_names
    ), "stock")
    # Written once: the threshold, the cut points and the rows are later read from it column-wise.
    seen, kept = Observation("raw quotes"), Observation("cleaned quotes")
    metrics = sinks.ticker_metrics(tickers)
    joined = stage(join_stock(raw, stock).observe(seen, *metrics), "joined")
    cleaned, thresholds = apply_transformations(joined, config)
    files = None
    if config.output_dir:
        root = f"{config.output_dir}/quotes"
        sinks.write_quotes(cleaned, root, observe=lambda rows: rows.observe(kept, *metrics))
        cleaned = spark.read.parquet(root)
        files = sinks.written_files(spark, root)
    else:
        cleaned = stage(cleaned.observe(kept, *metrics), "cleaned")
    counts = sinks.observed_counts(spark, tickers, seen, kept)
    metadata = sinks.run_metadata(joined, cleaned, thresholds, config, files, counts)
    if config.output_dir:
        sinks.write_metadata(metadata, f"{config.output_dir}/metadata")
        metadata = scans.read_metadata(spark, f"{config.output_dir}/metadata")
    requested = spark.createDataFrame([(t,) for t in tickers], "ticker string")
    summary = sinks.run_summary(requested, metadata, files)
    return ExtractRun(cleaned, metadata, summary)
