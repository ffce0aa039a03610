"""The daily series stored so that a reader touches only what it asks for.

Files lie in folders by month and by shard, a hash of the product; within a file
rows are sorted by product and day, and a bloom filter knows the products. A range
of days then reads the folders of its months, a product those of its shard, and
of these files only the row groups that may hold it.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewake.schema import KEY

# Folders a month is split into; as many as give files of a good size.
SHARDS = 8
# Selected products up to this many (some 10 MB) are broadcast, which also picks the shards; more are joined by shuffle.
BROADCAST_PRODUCTS = 100_000
# Products a file's bloom filter is sized for.
BLOOM_PRODUCTS = 100_000


def month_of(date: Column) -> Column:
    return F.year(date) * 100 + F.month(date)


def shard_of(category: Column, product_key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(category, product_key), F.lit(shards)).cast("int")


def store_series(daily: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write a daily series for ``read_series``; a folder is replaced.

    Rows are dealt by month, shard and product, so that a month's busiest shard
    is split among tasks and every folder has few files.
    """
    placed = daily.withColumns({"month": month_of(F.col("date")), "shard": shard_of(*map(F.col, KEY), shards)})
    order = ["month", "shard", *KEY, "date"]
    (
        placed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#product_key", "true")
        .option("parquet.bloom.filter.expected.ndv#product_key", str(BLOOM_PRODUCTS))
        .partitionBy("month", "shard")
        .parquet(path)
    )


def _between(rows: DataFrame, start: datetime.date | str | None, end: datetime.date | str | None) -> DataFrame:
    """The months as constants of the plan, so that other folders are no input, and the days as filters."""
    if start is not None:
        first = F.lit(start).cast("date")
        rows = rows.where((F.col("month") >= month_of(first)) & (F.col("date") >= first))
    if end is not None:
        last = F.lit(end).cast("date")
        rows = rows.where((F.col("month") <= month_of(last)) & (F.col("date") <= last))
    return rows


def read_series(
    spark: SparkSession,
    path: str,
    start: datetime.date | str | None = None,
    end: datetime.date | str | None = None,
    products: Iterable[tuple[str, str]] | None = None,
    shards: int = SHARDS,
) -> DataFrame:
    """Rows from ``start`` to ``end``, both included, of some (category, product_key) pairs or of all.

    The shards of the products are constants of the plan, like the months; days
    and keys are filters of the scan.
    """
    rows = _between(spark.read.parquet(path), start, end)
    if products is not None:
        named = list(products)
        if not named:
            return rows.where(F.lit(False)).drop("month", "shard")
        wanted = F.lit(False)
        for category, key in named:
            wanted = wanted | ((F.col("category") == category) & (F.col("product_key") == key))
        places = [shard_of(F.lit(category), F.lit(key), shards) for category, key in named]
        rows = rows.where(F.col("shard").isin(places) & F.col("product_key").isin([k for _, k in named]) & wanted)
    return rows.drop("month", "shard")


def read_selected(
    spark: SparkSession,
    path: str,
    selection: DataFrame,
    start: datetime.date | str | None = None,
    end: datetime.date | str | None = None,
    shards: int = SHARDS,
) -> DataFrame:
    """Rows of the products in ``selection``, known only at run time.

    A selection of checked size is broadcast; the shards it names then restrict
    the scan before it starts. A larger one is joined by shuffle.
    """
    chosen = selection.select(*KEY).distinct().withColumn("shard", shard_of(*map(F.col, KEY), shards))
    # Spark restricts a scan by the other side of a join only if that side has a filter.
    chosen = chosen.where(F.col("shard") >= 0)
    if chosen.limit(BROADCAST_PRODUCTS + 1).count() <= BROADCAST_PRODUCTS:
        chosen = F.broadcast(chosen)
    rows = _between(spark.read.parquet(path), start, end)
    kept = rows.join(chosen, ["shard", *KEY], "left_semi")
    return kept.select(*[c for c in rows.columns if c not in ("month", "shard")])
