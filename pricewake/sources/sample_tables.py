"""The driver's star-schema tables seen as ``products`` and ``price_history``.

Every expression is valid in Spark SQL and DuckDB alike, so a query and its
check read the very same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PRODUCTS_FROM_PART = """
select
  p_partkey as id,
  case when p_type in ('STANDARD', 'PROMO', 'SMALL') then 'tablet' else 'mobile' end as category,
  p_size <> 1 as is_active,
  case when p_partkey % 10 = 0 then concat('  ', upper(p_name), ' ', p_brand, ' ')
       else concat(p_name, ' ', p_brand) end as name,
  p_brand as brand,
  concat('Shop', cast(p_partkey % 5 as string)) as website,
  case p_size % 5 when 0 then '4' when 1 then '8' when 2 then '12' when 3 then '16'
       else null end as ram_gb,
  case p_size % 4 when 0 then '64' when 1 then '128' when 2 then '256' else '512' end as storage_gb,
  case when p_partkey % 7 = 0 then null
       else concat('https://shop', cast(p_partkey % 5 as string), '.example/p/',
                   cast(p_partkey as string)) end as url
from {part}
"""

PRICES_FROM_LINEITEM = """
select
  (l_orderkey * 10 + l_linenumber) * 10000 + l_suppkey as id,
  l_partkey as product_id,
  case when l_quantity = 1 then null
       else p_retailprice * (1 + 2 * (l_discount - l_tax)) end as price,
  l_shipdate as timestamp,
  cast(l_shipdate as date) as date
from {lineitem} join {part} on l_partkey = p_partkey
"""

PRICES_FROM_EVENTS = """
select event_id as id, user_id as product_id, value as price, ts as timestamp,
       cast(ts as date) as date
from {events}
"""


# Columns read from each table; stating them saves a job per scan.
_SCHEMAS = {
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_discount double, l_tax double, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, value double",
}


def paths(sf_dir: str) -> list[str]:
    """The files that the views below read."""
    return [f"{sf_dir}/{t}.parquet" for t in _SCHEMAS]


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    scans = {t: spark.read.schema(_SCHEMAS[t]).parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(sql, **scans)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PRODUCTS_FROM_PART, "part")


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PRICES_FROM_LINEITEM, "lineitem", "part")


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series with several observations per product and day."""
    return _view(spark, sf_dir, PRICES_FROM_EVENTS, "events")
