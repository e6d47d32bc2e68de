"""Explicit schemas of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and types of the vendor tables.
QUOTE_COLUMNS = """
    secid double, date date, symbol string, symbol_flag string, exdate date, last_date date,
    cp_flag string, strike_price double, best_bid double, best_offer double, volume double,
    open_interest double, impl_volatility double, delta double, gamma double, vega double,
    theta double, optionid double, cfadj double, am_settlement double, contract_size double,
    ss_flag string, forward_price double, expiry_indicator string, root string, suffix string
"""
STOCK_COLUMNS = """
    cusip string, permno int, permco int, issuno int, hexcd smallint, hsiccd int, date date,
    bidlo double, askhi double, prc double, vol double, ret double, bid double, ask double,
    shrout double, cfacpr double, cfacshr double, openprc double, numtrd int, retx double
"""
RATE_COLUMNS = "date date, treasury_2y double, tbills_3m double"
QUOTE_SCAN_COLUMNS = [
    "date", "secid", "symbol", "cp_flag", "exdate", "strike_price", "best_bid", "best_offer",
    "volume", "open_interest", "impl_volatility", "delta", "vega", "theta", "forward_price",
    "expiry_indicator",
]


_TYPES = {
    "double": T.DoubleType(), "date": T.DateType(), "string": T.StringType(),
    "int": T.IntegerType(), "smallint": T.ShortType(),
}


def _struct(columns: str) -> T.StructType:
    """Built without a session, so that importing the module needs none."""
    fields = [pair.split() for pair in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


QUOTE_SCHEMA = _struct(QUOTE_COLUMNS)
STOCK_SCHEMA = _struct(STOCK_COLUMNS)
RATE_SCHEMA = _struct(RATE_COLUMNS)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, so that predicates drop it."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns
    ])


def apply_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the columns that ``schema`` knows, keep the others out, and clear NaN.

    Columns of the schema that the input lacks are left out as well: extracts are projections.
    """
    present = {c.lower(): c for c in df.columns}
    cast = [
        F.col(present[f.name]).cast(f.dataType).alias(f.name)
        for f in schema if f.name in present
    ]
    return nan_to_null(df.select(*cast))
