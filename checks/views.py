"""Views of the test tables in the engine's shapes; one text for Spark SQL and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "quotes": ["lineitem"], "stock": ["orders"], "stock_raw": ["orders"], "names": ["customer"],
    "master": ["supplier"], "rates": ["orders"], "daily": ["lineitem"],
    "model_results": ["supplier"], "points": ["embeddings"], "setup_runs": ["supplier"],
    "short_series": ["events"],
}

VIEWS = {
    "quotes": """
select cast(l_suppkey % 4 as double) as secid,
       concat('T', cast(l_suppkey % 4 as string)) as ticker,
       cast(l_shipdate as date) as date,
       concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-',
              cast(l_partkey as string), '-', cast(l_suppkey as string), '-',
              cast(cast(l_quantity as int) as string)) as symbol,
       case when l_partkey % 2 = 0 then 'C' else 'P' end as cp_flag,
       cast(l_shipdate as date) + cast(l_quantity as int) * 3 as exdate,
       l_extendedprice as strike_price,
       case when l_partkey % 17 = 0 then cast(0 as double)
            else l_extendedprice / 1000 end as best_bid,
       case when l_partkey % 23 = 0 then l_extendedprice / 2000
            else l_extendedprice / 1000 * (1 + 10 * l_tax) end as best_offer,
       case when l_partkey % 11 = 0 then cast(0 as double) else l_quantity end as volume,
       cast(l_partkey % 5 as double) as open_interest,
       case when l_partkey % 29 = 0 then cast(null as double)
            else cast(0.1 as double) + 2 * l_discount + cast(l_partkey % 13 as double) / 100
            end as impl_volatility,
       (case when l_partkey % 2 = 0 then 1 else -1 end) * cast(l_partkey % 100 as double) / 100
            as delta,
       l_tax as vega,
       -l_discount as theta
from lineitem""",
    "stock": """
select concat('T', cast(o_custkey % 4 as string)) as ticker, cast(o_orderdate as date) as date,
       max(o_totalprice) as prc, cast(count(*) as double) as vol
from orders group by 1, 2""",
    "stock_raw": """
select cast(cast(floor(o_custkey / 4) as bigint) as string) as cusip, cast(o_orderdate as date) as date,
       max(o_totalprice) as prc, cast(count(*) as double) as vol
from orders group by 1, 2""",
    "names": """
select cast(cast(floor(c_custkey / 4) as bigint) as string) as cusip,
       concat('T', cast(c_custkey % 4 as string)) as ticker
from customer""",
    "master": """
select cast(s_suppkey % 4 as double) as secid, concat('T', cast(s_suppkey % 4 as string)) as ticker
from supplier""",
    "rates": """
select cast(o_orderdate as date) as date,
       cast(1 as double) + cast(count(*) % 7 as double) / 10 as treasury_2y
from orders group by 1 having count(*) % 5 <> 0""",
    "daily": """
select cast(l_shipdate as date) as date, concat('T', cast(l_suppkey % 2 as string)) as ticker,
       case when max(l_partkey) % 199 = 0 then cast(null as double)
            else min(cast(0.1 as double) + 2 * l_discount + cast(l_partkey % 13 as double) / 100)
            end as atm_iv,
       case when min(l_partkey) % 199 = 1 then cast(null as double)
            else max(cast(l_partkey % 100 as double) / 100) end as skew,
       max(l_tax) as curvature,
       cast(count(*) % 3 as int) as regime
from lineitem group by 1, 2""",
    "model_results": """
select concat('M', cast(s_suppkey % 7 as string)) as model,
       concat('T', cast(s_nationkey % 2 as string)) as ticker,
       cast(60 * (1 + s_suppkey % 3) as int) as w, s_suppkey as run_id, abs(s_acctbal) as mae
from supplier""",
    "points": """
select vec_id, embedding, label, cast(vec_id % 10 as int) as other from embeddings""",
    "setup_runs": """
select concat('T', cast(s_nationkey % 2 as string)) as ticker,
       case when s_suppkey % 3 = 0 then 'ward' else 'kmeans' end as method,
       cast(s_suppkey % 5 as double) / 10 as pca, s_suppkey as run_id,
       case when s_suppkey % 5 = 4 then cast(null as double)
            else cast(s_suppkey % 17 as double) / 20 end as silhouette
from supplier""",
    "short_series": """
select cast(ts as date) as date, event_type as ticker, max(value) as atm_iv, min(value) as skew
from events group by 1, 2""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables of ``sf_dir``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    text = VIEWS[name]
    for table in tables:
        text = text.replace(f"from {table}", "from {" + table + "}")
    return spark.sql(text, **tables)


def with_views(query: str, *names: str) -> str:
    """``query`` with the named views put before it as common table expressions."""
    inlined = ", ".join(f"{name} as ({VIEWS[name]})" for name in names)
    query = query.strip()
    return f"with {inlined}, {query[5:]}" if query.startswith("with ") else f"with {inlined} {query}"
