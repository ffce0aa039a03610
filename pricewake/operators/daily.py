"""Daily roll-up: one price per product per day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewake.operators.ingest import clean_prices, tracked_products
from pricewake.schema import KEY


def fold_days(observations: DataFrame) -> DataFrame:
    """Observations folded per listing and day.

    All buffers are fixed width, so both phases are hash aggregates, and a
    busy listing leaves each map task as one row per day.
    """
    return observations.groupBy("product_id", "date").agg(
        F.sum("price").alias("price_sum"),
        F.count("price").alias("price_n"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def daily_prices(
    products: DataFrame,
    prices: DataFrame,
    category: str | None = None,
    stored_date: bool = False,
    keep_missing_price: bool = False,
) -> DataFrame:
    """Mean price and listing attributes per product and day.

    Name, brand, website and specs are the first of the day, the URL the last,
    missing values skipped. Observation order is (timestamp, product_id):
    attributes belong to the listing, so this order is total for them.
    """
    folded = fold_days(clean_prices(prices, stored_date, keep_missing_price))
    return daily_from_days(products, folded, category)


def daily_from_days(
    products: DataFrame, days: DataFrame, category: str | None = None
) -> DataFrame:
    """Daily prices from folded listing-days.

    Sums, counts and bounds merge, so ``days`` may hold several rows for one
    listing and day, as when they were folded batch by batch.
    """
    listed = tracked_products(products, category).where(F.col("product_key").isNotNull())
    return roll_up(days.join(listed, "product_id"))


def roll_up(listed: DataFrame) -> DataFrame:
    """Listing-days with attributes merged into product-days."""
    first = [
        F.expr(
            f"min_by({c}, struct(first_ts, product_id)) filter (where {c} is not null)"
        ).alias(c)
        for c in ("name", "brand", "website")
    ]
    last_url = F.expr(
        "max_by(URL, struct(last_ts, product_id)) filter (where URL is not null)"
    ).alias("URL")
    return listed.groupBy(*KEY, "date").agg(
        F.try_divide(F.sum("price_sum"), F.sum("price_n")).alias("price"),
        *first,
        # Part of the key, hence equal in the whole group: a plain minimum
        # keeps callers that need only price and specs on hash aggregation.
        F.min("ram_gb").alias("ram_gb"),
        F.min("storage_gb").alias("storage_gb"),
        last_url,
        F.min("first_ts").alias("timestamp"),
    )


def daily_means(prices: DataFrame) -> DataFrame:
    """Mean price per listing and day, for a price table without listings."""
    folded = fold_days(clean_prices(prices))
    return folded.select(
        "product_id",
        "date",
        F.try_divide("price_sum", "price_n").alias("price"),
        F.col("price_n").alias("n_obs"),
        F.col("first_ts").alias("timestamp"),
    )
