"""Reading and writing the two input tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewake.schema import PRICE_HISTORY, PRODUCTS

_FORMATS = ("parquet", "orc", "json", "csv")


def read_table(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    **options: str,
) -> DataFrame:
    """Partitioned file scan. Text formats need ``schema``; nothing is inferred from data."""
    if fmt not in _FORMATS:
        raise ValueError(f"format {fmt!r} not in {_FORMATS}")
    if fmt in ("json", "csv") and schema is None:
        raise ValueError(f"{fmt} needs an explicit schema")
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", options.get("header", "true"))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_products(
    spark: SparkSession, path: str | list[str], fmt: str = "parquet", **options: str
) -> DataFrame:
    # Parquet and ORC carry their own types; text needs ours.
    schema = PRODUCTS if fmt in ("json", "csv") else None
    return read_table(spark, path, fmt, schema, **options)


def read_price_history(
    spark: SparkSession, path: str | list[str], fmt: str = "parquet", **options: str
) -> DataFrame:
    schema = PRICE_HISTORY if fmt in ("json", "csv") else None
    return read_table(spark, path, fmt, schema, **options)


def jdbc_options(
    url: str,
    table: str,
    column: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options for a range-partitioned read: one query per id range instead of row paging."""
    if lower >= upper or partitions < 1:
        raise ValueError("need lower < upper and at least one partition")
    return {
        "fetchsize": "10000",
        **(properties or {}),
        "url": url,
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    options = jdbc_options(url, table, column, lower, upper, partitions, properties)
    return spark.read.format("jdbc").options(**options).load()


def balanced_predicates(keys: Iterable[int], column: str, partitions: int) -> list[str]:
    """Conditions that split a table into about equally many rows, from a sample of its keys.

    Equal steps of the key, as ``jdbc_options`` takes them, leave empty and huge
    parts where ids have gaps; quantiles of a sample do not. Each row meets one
    condition, a null key the first. Fewer than ``partitions`` come out where
    keys of the sample repeat.
    """
    if partitions < 1:
        raise ValueError("need at least one partition")
    ordered = sorted(keys)
    cuts = sorted({ordered[len(ordered) * k // partitions] for k in range(1, partitions)} - {ordered[0]}) if ordered else []
    if not cuts:
        return ["1 = 1"]
    first = [f"{column} < {cuts[0]} or {column} is null"]
    inner = [f"{column} >= {low} and {column} < {high}" for low, high in zip(cuts, cuts[1:])]
    return [*first, *inner, f"{column} >= {cuts[-1]}"]


# Keys sampled for each part of a balanced read.
SAMPLED_KEYS = 100


def key_sample_query(table: str, column: str, rows: int, partitions: int) -> str:
    """SQL for a spread of a table's keys by their remainder, about ``SAMPLED_KEYS`` for each part."""
    step = max(1, rows // (SAMPLED_KEYS * partitions))
    return f"select {column} from {table} where mod({column}, {step}) = 0"


def read_jdbc_balanced(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    rows: int,
    partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table of about ``rows`` rows read in parts of about equal size, whatever the gaps between its keys."""
    options = {"fetchsize": "10000", **(properties or {})}
    query = key_sample_query(table, column, rows, partitions)
    sample = spark.read.format("jdbc").options(**options, url=url, query=query).load()
    predicates = balanced_predicates([r[0] for r in sample.collect()], column, partitions)
    return spark.read.jdbc(url, table, predicates=predicates, properties=options)


def scan_counts(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows per input table."""
    return products.agg(F.count("*").alias("n_rows")).select(
        F.lit("products").alias("table_name"), "n_rows"
    ).unionByName(
        prices.agg(F.count("*").alias("n_rows")).select(
            F.lit("price_history").alias("table_name"), "n_rows"
        )
    )
