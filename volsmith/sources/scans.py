"""Scans of quotes, prices, rates, stored slices and run metadata."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volsmith.config import FETCH_ROWS
from volsmith.operators.joins import join_master, join_names
from volsmith.sources.schemas import (
    QUOTE_SCAN_COLUMNS, QUOTE_SCHEMA, RATE_SCHEMA, STOCK_SCHEMA, apply_schema, nan_to_null,
)


def read_table(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A Parquet path (file or partitioned folder), or a DataFrame passed through."""
    return source if isinstance(source, DataFrame) else spark.read.parquet(source)


def read_jdbc(
    spark: SparkSession, url: str, table: str, from_date: str, to_date: str,
    partitions: int = 64, fetch_rows: int = FETCH_ROWS, **options: str,
) -> DataFrame:
    """A database table read in parallel date slices, ``fetch_rows`` rows per round trip."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn="date", lowerBound=from_date,
            upperBound=to_date, numPartitions=str(partitions), fetchsize=str(fetch_rows), **options,
        )
        .load()
    )


def _between(from_date: str, to_date: str) -> Column:
    return F.col("date").between(F.lit(from_date).cast("date"), F.lit(to_date).cast("date"))


def scan_quotes(
    spark: SparkSession, source: str | DataFrame, secids: DataFrame | Iterable[float] | None,
    from_date: str, to_date: str,
) -> DataFrame:
    """Traded quotes of some securities in a date range.

    ``secids`` is a DataFrame with a ``secid`` column, a short list, or None for all. Every
    predicate is a plain comparison and reaches the scan.
    """
    raw = read_table(spark, source)
    columns = [c for c in QUOTE_SCAN_COLUMNS if c in raw.columns]
    quotes = raw.where(_between(from_date, to_date) & (F.col("volume") > 0))
    if isinstance(secids, DataFrame):
        quotes = quotes.join(secids.select("secid").distinct(), "secid", "left_semi")
    elif secids is not None:
        quotes = quotes.where(F.col("secid").isin([float(s) for s in secids]))
    # Volume is tested again because NaN > 0 holds in Spark and only becomes NULL here.
    return apply_schema(quotes.select(*columns), QUOTE_SCHEMA).where(F.col("volume") > 0)


def scan_stock(
    spark: SparkSession, source: str | DataFrame, names: str | DataFrame,
    tickers: Iterable[str], from_date: str | None = None, to_date: str | None = None,
    dedupe: bool = False,
) -> DataFrame:
    """Daily prices of some tickers, found through the names table."""
    prices = read_table(spark, source)
    if from_date and to_date:
        prices = prices.where(_between(from_date, to_date))
    prices = apply_schema(prices.select("cusip", "date", "prc", "vol"), STOCK_SCHEMA)
    wanted = read_table(spark, names).where(F.col("ticker").isin(list(tickers)))
    return join_names(prices, wanted, dedupe).select("ticker", "date", "prc", "vol")


def resolve_secids(master: DataFrame, tickers: Iterable[str]) -> DataFrame:
    """The distinct security ids behind some tickers; empty when none is known (S3)."""
    return master.where(F.col("ticker").isin(list(tickers))).select("secid", "ticker").distinct()


def scan_yearly(
    spark: SparkSession, tables: Iterable[str | DataFrame], master: DataFrame,
    tickers: Iterable[str], from_date: str, to_date: str,
) -> DataFrame:
    """Stack yearly quote tables and attach their tickers."""
    years = [read_table(spark, t).where(_between(from_date, to_date)) for t in tables]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), years)
    return nan_to_null(join_master(stacked, master, tickers))


def scan_rates(
    spark: SparkSession, source: str | DataFrame, from_date: str, to_date: str,
) -> DataFrame:
    """Daily rates under their analysis names."""
    raw = read_table(spark, source)
    named = {"dgs2": "treasury_2y", "dtb3": "tbills_3m"}
    columns = [F.col(c).alias(named.get(c, c)) for c in raw.columns
               if c in named or c in ("date", *named.values())]
    return apply_schema(raw.select(*columns).where(_between(from_date, to_date)), RATE_SCHEMA)


def read_slice(
    spark: SparkSession, source: str | DataFrame, tickers: str | Iterable[str],
    first_year: int, last_year: int,
) -> tuple[DataFrame, DataFrame]:
    """Rows of the asked (ticker, year) partitions, and the partitions that do not exist."""
    asked = [tickers] if isinstance(tickers, str) else list(tickers)
    table = read_table(spark, source)
    found = table.where(
        F.col("ticker").isin(asked) & F.col("year").between(first_year, last_year)
    )
    grid = (
        spark.range(1)
        .select(F.explode(F.array(*[F.lit(t) for t in asked])).alias("ticker"))
        .select("ticker", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("year"))
    )
    missing = grid.join(found.select("ticker", "year").distinct(), ["ticker", "year"], "left_anti")
    return found, missing


def read_metadata(spark: SparkSession, path: str, ticker: str | None = None) -> DataFrame:
    """Run metadata documents written by ``write_metadata``."""
    from volsmith.sources.sinks import METADATA_SCHEMA

    documents = spark.read.schema(METADATA_SCHEMA).json(path)
    return documents if ticker is None else documents.where(F.col("ticker") == ticker)
