"""Run registered queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path
from typing import Any

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            connection.execute(f"create view {table} as select * from '{path}'")
    return connection


def _plain(value: Any) -> Any:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(value)
    return value


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark_df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when columns and rows agree, otherwise what differs."""
    ours = spark_df.collect()
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    a, b = rows_of(spark_df.columns, ours), rows_of(names, theirs)
    if a == b:
        return None
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    return (f"{len(ours)} rows against {len(theirs)}; {len(only_a)} only here {only_a[:2]}; "
            f"{len(only_b)} only there {only_b[:2]}")


def run(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> int:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES

    connection, failures = connect(sf_dir), 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                found = difference(frame, connection, ORACLES[name])
                verdict = "ok" if found is None else f"DIFFERS {found}"
            else:
                verdict = f"rows {len(frame.collect())}"
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failures += not verdict.startswith(("ok", "rows"))
        print(f"{name:24s} {time.time() - start:6.2f}s {verdict}", flush=True)
    return failures


if __name__ == "__main__":
    from volsmith.session import get_spark

    session = get_spark("checks", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g"})
    session.sparkContext.setLogLevel("OFF")
    sys.exit(bool(run(session, sys.argv[1], sys.argv[2:] or None)))
