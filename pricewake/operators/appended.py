"""New days of a series without its history: carried prices for the features, stored moments for the fit."""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewake.operators.features import Profile, add_features
from pricewake.operators.model import LinearModel, from_moments
from pricewake.schema import KEY
from pricewake.sources.stored import folder_names, store

# Rows that the longest look-back, a lag of seven, needs before a new one.
CARRIED = 7
_COLUMNS = [*KEY, "date", "price", "ram_gb", "storage_gb"]


def series_tail(daily: DataFrame) -> DataFrame:
    """What features of later days need: the last rows of every product and its ``first_day``."""
    from_end = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("date")))
    first = F.min("date").over(Window.partitionBy(*KEY))
    first = F.coalesce(F.min("first_day").over(Window.partitionBy(*KEY)), first) if "first_day" in daily.columns else first
    return (
        daily.withColumns({"from_end": from_end, "first_day": first})
        .where(F.col("from_end") <= CARRIED)
        .select(*_COLUMNS, "first_day")
    )


def append_days(
    tail: DataFrame, days: DataFrame, profile: Profile, anchor: datetime.date | None = None
) -> tuple[DataFrame, DataFrame]:
    """Features of new daily rows, and the tail for the days after them.

    Reads the tail and the new rows alone: at most ``CARRIED`` rows of a product
    beside its new ones. A product without a tail begins here. Days come in
    order: one that does not follow its product's tail raises, as the features
    after it would change too. A profile with a global anchor needs its first day.
    """
    if profile.global_anchor and anchor is None:
        raise ValueError("days cannot be counted without the anchor")
    both = tail.withColumn("is_new", F.lit(False)).unionByName(
        days.select(*_COLUMNS, F.lit(None).cast("date").alias("first_day"), F.lit(True).alias("is_new"))
    )
    product = Window.partitionBy(*KEY)
    last = F.max(F.when(~F.col("is_new"), F.col("date"))).over(product)
    first = F.coalesce(F.min("first_day").over(product), F.min("date").over(product))
    late = F.col("is_new") & (F.col("date") <= F.col("last_day"))
    message = F.concat(F.lit("not after the carried days: "), F.col("product_key"), F.lit(" "), F.col("date").cast("string"))
    both = both.withColumns({"last_day": last, "first_day": first}).withColumn(
        "date", F.when(late, F.raise_error(message).cast("date")).otherwise(F.col("date"))
    )
    featured = add_features(both, profile, None if anchor is None else F.lit(anchor))
    if not profile.global_anchor:
        featured = featured.withColumn("day_index", F.datediff("date", "first_day"))
    return featured.where("is_new").drop("is_new", "last_day", "first_day"), series_tail(both)


def _by_day(rows: DataFrame, columns: list[str], centre: dict[str, float]) -> DataFrame:
    """Per day and place the sums of the products of the constant and the columns, less their centre."""
    shifted = [F.col(c).cast("double") - F.lit(float(centre[c])) for c in columns]
    placed = rows.select("date", F.array(F.lit(1.0), *shifted).alias("x")).select("date", "x", F.posexplode("x").alias("i", "xi"))
    sums = [F.sum(F.col("xi") * F.get("x", F.lit(j))).alias(f"m_{j}") for j in range(len(columns) + 1)]
    return placed.groupBy("date", "i").agg(*sums)


def store_moments(rows: DataFrame, path: str, features: tuple[str, ...], target: str = "target") -> None:
    """Add the moments of training rows to a store, a folder a day; a day that is there is replaced.

    The first rows set the centre that all products are taken about, which keeps
    them well conditioned; it stays, so that days add up. ``rows`` are read once,
    twice the first time: store them beforehand if they are costly.
    """
    spark, columns = rows.sparkSession, [*features, target]
    if not folder_names(spark, f"{path}/centre"):
        store(rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]), f"{path}/centre")
    centre = spark.read.parquet(f"{path}/centre").first().asDict()
    days = _by_day(rows, columns, centre)
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{path}/days")


def fit_window(
    spark: SparkSession,
    path: str,
    features: tuple[str, ...],
    category: str,
    start: datetime.date | None = None,
    end: datetime.date | None = None,
    target: str = "target",
    anchor: datetime.date | None = None,
) -> LinearModel:
    """Least squares over the stored days from ``start`` to ``end``, both included.

    Days outside are folders that are not read, so leaving the window costs
    nothing and leaves no rounding behind. The driver gets one row per feature.
    """
    columns = [*features, target]
    centre = spark.read.parquet(f"{path}/centre").first().asDict()
    days = spark.read.parquet(f"{path}/days")
    if start is not None:
        days = days.where(F.col("date") >= F.lit(start))
    if end is not None:
        days = days.where(F.col("date") <= F.lit(end))
    names = [f"m_{j}" for j in range(len(columns) + 1)]
    full = np.zeros((len(names), len(names)))
    for line in days.groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).collect():
        full[line["i"]] = line[1:]
    if not full[0, 0]:
        raise ValueError("no rows on the days asked for")
    return from_moments(full, centre, features, category, target, anchor)
