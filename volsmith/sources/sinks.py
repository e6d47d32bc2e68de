"""Writers of cleaned quotes, feature tables and run metadata (K1-K6)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from importlib import import_module
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from volsmith.config import ROW_GROUP_ROWS, PipelineConfig

MANIFEST = "module string, kind string, predictions bigint"
METADATA_SCHEMA = """
    ticker string,
    processing_config struct<
        date_range: struct<from_date: string, to_date: string>,
        volume_percentile: double, batch_size: int>,
    data_statistics struct<
        volume_threshold: double, total_records_raw: bigint, total_records_written: bigint,
        filter_retention_rate: double, years_available: array<int>>,
    files_created array<string>,
    processing_timestamp string,
    schema map<string, string>
"""


def ticker_metrics(tickers: Sequence[str]) -> list[Column]:
    """Rows and years of each asked ticker, as metrics that a write can observe."""
    own = [F.col("ticker") == t for t in tickers]
    counts = [F.count_if(c).alias(f"n{i}") for i, c in enumerate(own)]
    return counts + [F.collect_set(F.when(c, F.year("date"))).alias(f"years{i}") for i, c in enumerate(own)]


def observed_counts(spark: SparkSession, tickers: Sequence[str], raw: Observation, written: Observation) -> DataFrame:
    """ticker, n_raw, n_written, years: what two finished writes saw; tickers without raw rows are left out."""
    before, after = raw.get, written.get
    rows = [(t, before[f"n{i}"], after[f"n{i}"], sorted(after[f"years{i}"])) for i, t in enumerate(tickers) if before[f"n{i}"]]
    return spark.createDataFrame(rows, "ticker string, n_raw bigint, n_written bigint, years array<int>")


def write_quotes(
    df: DataFrame, root: str, rows_per_file: int = 20 * ROW_GROUP_ROWS,
    observe: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Cleaned quotes under ``ticker=/year=`` folders, Snappy, sorted by date in each file (K1).

    Rebalancing splits a hot (ticker, year) over several tasks and merges small ones by their real
    size, so files come out even. Years without rows get no folder. ``observe`` adds metrics as the last step
    before the files, where a task that is run again is counted once.
    """
    even = df.drop("month", "day").hint("rebalance", "ticker", "year").sortWithinPartitions("ticker", "year", "date")
    (
        (observe(even) if observe else even)
        .write.mode("overwrite")
        .option("compression", "snappy")
        .option("parquet.block.row.count.limit", str(ROW_GROUP_ROWS))
        .option("maxRecordsPerFile", str(rows_per_file))
        .partitionBy("ticker", "year")
        .parquet(root)
    )


def write_partitioned(df: DataFrame, path: str, keys: Iterable[str]) -> None:
    """A Parquet dataset partitioned by the given keys (K2)."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """An unpartitioned Parquet dataset (K3)."""
    df.write.mode("overwrite").parquet(path)


def run_metadata(
    raw: DataFrame, cleaned: DataFrame, thresholds: DataFrame, config: PipelineConfig,
    files: DataFrame | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """One metadata document per ticker (K4).

    ``raw`` is counted before any filter, so the retention rate is the true one. ``files`` has
    columns ticker and file; without it the list is empty. ``counts`` (``observed_counts`` of the writes)
    spares reading ``raw`` and ``cleaned`` again.
    """
    if counts is None:
        counted = raw.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_raw"))
        written = cleaned.groupBy("ticker").agg(
            F.count(F.lit(1)).alias("n_written"),
            F.sort_array(F.collect_set(F.year("date"))).alias("years"),
        )
        counts = counted.join(written, "ticker", "left")
    joined = counts.join(
        thresholds.select("ticker", "volume_threshold"), "ticker", "left"
    )
    if files is not None:
        listed = files.groupBy("ticker").agg(F.sort_array(F.collect_set("file")).alias("files"))
        joined = joined.join(listed, "ticker", "left")
    else:
        joined = joined.withColumn("files", F.lit(None).cast("array<string>"))
    types = F.create_map(*[F.lit(part) for pair in cleaned.dtypes for part in pair])
    n_written = F.coalesce("n_written", F.lit(0).cast("bigint"))
    columns = [
        F.col("ticker"),
        F.struct(
            F.struct(
                F.lit(config.from_date).alias("from_date"), F.lit(config.to_date).alias("to_date")
            ).alias("date_range"),
            F.lit(config.volume_quantile).alias("volume_percentile"),
            F.lit(config.fetch_rows).alias("batch_size"),
        ).alias("processing_config"),
        F.struct(
            F.col("volume_threshold"),
            F.col("n_raw").alias("total_records_raw"),
            n_written.alias("total_records_written"),
            (n_written / F.col("n_raw")).alias("filter_retention_rate"),
            F.coalesce("years", F.array().cast("array<int>")).alias("years_available"),
        ).alias("data_statistics"),
        F.coalesce("files", F.array().cast("array<string>")).alias("files_created"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(
            "processing_timestamp"
        ),
        types.alias("schema"),
    ]
    return joined.select(*columns)


def written_files(spark: SparkSession, root: str) -> DataFrame:
    """The files of a ``ticker=/year=`` dataset, one row per (ticker, file); only the folders are listed."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(root)
    return listed.select(F.col("ticker").cast("string").alias("ticker"), F.col("path").alias("file"))


def write_metadata(metadata: DataFrame, path: str) -> None:
    """Metadata documents as JSON lines."""
    metadata.write.mode("overwrite").json(path)


def run_summary(requested: DataFrame, metadata: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Status of every asked ticker (K5); a ticker without documents did not get through.

    ``files`` (ticker, file) is counted by ticker; without it the documents' lists are.
    """
    stats = "data_statistics"
    asked = requested.select("ticker").distinct().join(metadata, "ticker", "left")
    n_files = F.array_size("files_created")
    if files is not None:
        asked = asked.join(files.groupBy("ticker").agg(F.count("*").cast("int").alias("n_files")), "ticker", "left")
        n_files = F.col("n_files")
    return asked.select(
        "ticker",
        F.when(F.col(stats).isNull(), "failed")
        .when(F.col(f"{stats}.total_records_written") == 0, "empty")
        .otherwise("success").alias("status"),
        F.when(F.col(stats).isNull(), "no quotes found")
        .when(F.col(f"{stats}.total_records_written") == 0, "no rows after filtering")
        .alias("reason"),
        F.coalesce(n_files, F.lit(0)).alias("files_created"),
        F.coalesce(F.col(f"{stats}.total_records_raw"), F.lit(0).cast("bigint"))
        .alias("records_processed"),
        F.coalesce(F.col(f"{stats}.total_records_written"), F.lit(0).cast("bigint"))
        .alias("records_written"),
        F.col(f"{stats}.volume_threshold").alias("volume_threshold"),
    )


def save_model(model: Any, path: str) -> None:
    """A fitted Spark ML model (K6)."""
    model.write().overwrite().save(path)


@dataclass
class SavedRun:
    """A model read back and the predictions saved with it."""

    model: Any
    predictions: DataFrame


def save_run(model: Any, predictions: DataFrame, path: str) -> None:
    """A fitted Spark ML model, its predictions and, last of all, a manifest (K6).

    A folder without a manifest is a run that did not finish; the manifest names the model's class.
    """
    spark = predictions.sparkSession
    save_model(model, f"{path}/model")
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    kind = type(model)
    rows = spark.read.parquet(f"{path}/predictions").count()
    spark.createDataFrame([(kind.__module__, kind.__name__, rows)], MANIFEST).coalesce(1).write.mode("overwrite").json(
        f"{path}/manifest")


def load_run(spark: SparkSession, path: str) -> SavedRun:
    """What ``save_run`` wrote; an error if the manifest is missing or counts other rows."""
    try:
        manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    except AnalysisException as error:
        raise FileNotFoundError(f"no finished run in {path}") from error
    predictions = spark.read.parquet(f"{path}/predictions")
    if manifest is None or predictions.count() != manifest["predictions"]:
        raise ValueError(f"the run in {path} is not complete")
    kind = getattr(import_module(manifest["module"]), manifest["kind"])
    return SavedRun(kind.load(f"{path}/model"), predictions)
