"""Fold new price files into stored partials instead of re-reading the history.

What is stored are partials per listing and day (sums) and per listing (counts,
first and last price with their places). They merge in any order, so a late
observation just adds a partial row. ``daily.daily_from_days`` turns the days into
the series, ``ingest.fold_products`` of ``stored_ends`` into catalogue, movers and
latest URLs.

A source that sends observations again names a delay: then a repeated id counts
once, and what arrives later than the delay behind the newest observation is left
out, as its id is not remembered any more. State is as large as the delay.

A store is one folder on shared storage:

* ``days/batch=N``, ``ends/batch=N``: the partial rows of one run's batch;
* ``merged/upto=N``, ``ends-merged/upto=N``: all batches up to N merged;
* ``_checkpoint``: what has been read, which belongs to this store alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pricewake.functions import cleaning
from pricewake.operators.daily import fold_days
from pricewake.operators.ingest import clean_prices, fold_ends, merge_ends
from pricewake.schema import PRICE_HISTORY
from pricewake.sources.stored import folder_names, remove_folder

_BATCH, _UPTO = "batch", "upto"


@dataclass(frozen=True)
class Partials:
    """One kind of stored rows: its folders, schema, how observations become rows, and how rows merge."""

    batches: str
    merges: str
    schema: T.StructType
    fold: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]


def merge_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy("product_id", "date").agg(
        F.sum("price_sum").alias("price_sum"),
        F.sum("price_n").alias("price_n"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )


DAYS = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("price_sum", T.DoubleType()),
        T.StructField("price_n", T.LongType()),
        T.StructField("first_ts", T.TimestampType()),
        T.StructField("last_ts", T.TimestampType()),
    ]
)
_AT = T.DecimalType(38, 0)
ENDS = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_prices", T.LongType()),
        T.StructField("first_at", _AT),
        T.StructField("last_at", _AT),
        T.StructField("first_price", T.DoubleType()),
        T.StructField("last_price", T.DoubleType()),
    ]
)

DAY_SUMS = Partials(
    "days", "merged", DAYS, lambda rows: fold_days(rows.where("timestamp is not null and price is not null")), merge_days
)
LISTING_ENDS = Partials(
    "ends",
    "ends-merged",
    ENDS,
    lambda rows: fold_ends(
        rows.withColumn("date", F.col("stored_day")).where("timestamp is not null and date is not null")
    ),
    merge_ends,
)


def read_new_prices(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Price files as a stream; each file is read once.

    Without a ``schema``, Parquet and ORC bring their own types, taken from the
    files that are there, and text formats the text schema.
    """
    if schema is None:
        typed = fmt in ("parquet", "orc")
        schema = spark.read.format(fmt).load(path).schema if typed else PRICE_HISTORY
    return spark.readStream.schema(schema).format(fmt).load(path)


def distinct_observations(observations: DataFrame, delay: str) -> DataFrame:
    """Observations of a stream without those that repeat an id, or come more than ``delay`` late.

    Ids are remembered until the watermark, ``delay`` behind the newest timestamp
    seen, has passed them by the same time. An observation without an id is known
    by its listing, time and price.
    """
    content = F.concat_ws("|", F.lit("-"), "product_id", "timestamp", "price")
    known = observations.withColumn("same", F.coalesce(F.col("obs_id").cast("string"), content))
    return known.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["same"]).drop("same")


def store_prices(
    prices: DataFrame,
    path: str,
    kinds: Iterable[Partials] = (DAY_SUMS, LISTING_ENDS),
    delay: str | None = None,
) -> StreamingQuery:
    """Fold everything new in the stream ``prices`` into the store ``path`` and stop.

    A batch has its own directory and overwrites it when repeated after a
    failure, so each observation is counted once. With a ``delay`` so are
    observations sent twice. A store that has batches but lost its checkpoint is
    refused: its source would be counted again.
    """
    spark = prices.sparkSession
    kinds = list(kinds)
    has_rows = any(folder_names(spark, f"{path}/{name}") for k in kinds for name in (k.batches, k.merges))
    if has_rows and not folder_names(spark, f"{path}/_checkpoint"):
        raise ValueError(f"{path} holds batches but no checkpoint")
    # The stored day for what is ordered by it; the timestamp's for the days.
    typed = _typed(prices)
    if delay is not None:
        typed = distinct_observations(typed, delay)

    def write(rows: DataFrame, batch: int) -> None:
        kept = rows.persist() if len(kinds) > 1 else rows
        for kind in kinds:
            kind.fold(kept).write.mode("overwrite").parquet(f"{path}/{kind.batches}/{_BATCH}={batch}")
        if len(kinds) > 1:
            kept.unpersist()

    return (
        typed.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def _typed(prices: DataFrame) -> DataFrame:
    """Observations as ``clean_prices`` gives them, all that have a time, with their stored day too."""
    day = cleaning.day(F.col("date"), prices.schema["date"].dataType)
    with_day = prices.withColumn("stored_day", day)
    return clean_prices(with_day, keep_missing_price=True, also=("stored_day",))


def store_days(prices: DataFrame, path: str, delay: str | None = None) -> StreamingQuery:
    """``store_prices`` with the sums of the daily series alone."""
    return store_prices(prices, path, (DAY_SUMS,), delay)


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    return sorted(
        int(name.removeprefix(f"{prefix}="))
        for name in folder_names(spark, path)
        if name.startswith(f"{prefix}=")
    )


def _merged_upto(spark: SparkSession, path: str, kind: Partials) -> int:
    """Last batch of the newest complete merge; -1 without any."""
    done = [
        n
        for n in _numbers(spark, f"{path}/{kind.merges}", _UPTO)
        if "_SUCCESS" in folder_names(spark, f"{path}/{kind.merges}/{_UPTO}={n}")
    ]
    return max(done, default=-1)


def stored(spark: SparkSession, path: str, kind: Partials) -> DataFrame:
    """Partial rows of the newest merge and of the batches after it."""
    upto = _merged_upto(spark, path, kind)
    rows = spark.createDataFrame([], kind.schema)
    read = spark.read.schema(kind.schema)
    if upto >= 0:
        rows = rows.unionByName(read.parquet(f"{path}/{kind.merges}/{_UPTO}={upto}"))
    for batch in _numbers(spark, f"{path}/{kind.batches}", _BATCH):
        if batch > upto:
            rows = rows.unionByName(read.parquet(f"{path}/{kind.batches}/{_BATCH}={batch}"))
    return rows


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    return stored(spark, path, DAY_SUMS)


def stored_ends(spark: SparkSession, path: str) -> DataFrame:
    """Partial rows for ``ingest.folded_from_ends``: counts and ends of every listing."""
    return stored(spark, path, LISTING_ENDS)


def compact(spark: SparkSession, path: str, kind: Partials) -> None:
    """Merge all batches of a kind; run it between runs of the stream.

    The merge counts only once it is complete, and only then are the batches and
    the merge it replaces removed: a failure at any point leaves the sums as they are.
    """
    batches = _numbers(spark, f"{path}/{kind.batches}", _BATCH)
    upto = _merged_upto(spark, path, kind)
    if not batches or batches[-1] <= upto:
        return
    merged = kind.merge(stored(spark, path, kind))
    merged.write.mode("overwrite").parquet(f"{path}/{kind.merges}/{_UPTO}={batches[-1]}")
    for batch in batches:
        remove_folder(spark, f"{path}/{kind.batches}/{_BATCH}={batch}")
    if upto >= 0:
        remove_folder(spark, f"{path}/{kind.merges}/{_UPTO}={upto}")


def compact_days(spark: SparkSession, path: str) -> None:
    compact(spark, path, DAY_SUMS)


def compact_store(spark: SparkSession, path: str) -> None:
    for kind in (DAY_SUMS, LISTING_ENDS):
        compact(spark, path, kind)
