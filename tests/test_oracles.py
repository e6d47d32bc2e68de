"""Every registered query with SQL gives the same rows on Spark and DuckDB."""

from __future__ import annotations

import pytest

from checks.compare import connect, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES
from checks.views import view
from volsmith.operators import clean


@pytest.fixture(scope="module")
def duck(sf):
    connection = connect(sf)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_matches_sql(spark, sf, duck, name):
    assert difference(QUERIES[name](spark, sf), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["regime_discovery", "ward_clusters", "ward_tree", "kmeans_regimes", "sample_rows"])
def test_query_can_be_stored(spark, sf, tmp_path, name):
    found = QUERIES[name](spark, sf)
    assert len({c.lower() for c in found.columns}) == len(found.columns)
    found.write.parquet(str(tmp_path / name))
    back = spark.read.parquet(str(tmp_path / name))
    assert back.columns == found.columns and back.count() == found.count()


def test_samples_do_not_follow_the_partitioning(spark, sf):
    quotes = view(spark, sf, "quotes").select("symbol")
    one = {r[0] for r in clean.sample_rows(quotes, 20, ["symbol"]).collect()}
    assert one == {r[0] for r in clean.sample_rows(quotes.repartition(7), 20, ["symbol"]).collect()}
    assert one != {r[0] for r in clean.sample_rows(quotes, 20, ["symbol"], seed=43).collect()}


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_modules_load_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
