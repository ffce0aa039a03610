"""Search, facets, catalogue, per-product statistics and history.

Search and facet filters read listing attributes only, so they work on raw
observations and on listings folded by ``ingest.fold_products`` alike.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewake.schema import KEY


def search(rows: DataFrame, term: str | None, literal: bool = False) -> DataFrame:
    """Rows whose name matches the regular expression ``term``, ignoring case.

    An empty term keeps everything; ``literal`` matches the term as plain text.
    """
    if not term:
        return rows
    pattern = "(?iu)" + (re.escape(term) if literal else term)
    return rows.where(F.col("name").rlike(pattern))


def facet_filter(
    rows: DataFrame,
    brands: Iterable[str] = (),
    websites: Iterable[str] = (),
    rams: Iterable[int] = (),
    storages: Iterable[int] = (),
) -> DataFrame:
    """Any value within a facet, all facets together; an empty facet filters nothing."""
    chosen = {"brand": brands, "website": websites, "ram_gb": rams, "storage_gb": storages}
    for column, values in chosen.items():
        picked = list(values)
        if picked:
            rows = rows.where(F.col(column).isin(picked))
    return rows


def facet_values(rows: DataFrame) -> DataFrame:
    """Distinct values of each facet. Pass rows after search, before facet filters."""
    text, amount = ("brand", "website"), ("ram_gb", "storage_gb")
    entries = [
        F.struct(
            F.lit(c).alias("facet"), F.col(c).alias("value"), F.lit(None).cast("int").alias("amount")
        )
        for c in text
    ] + [
        F.struct(
            F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"), F.col(c).alias("amount")
        )
        for c in amount
    ]
    return (
        rows.select("category", F.inline(F.array(*entries)))
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("category", "facet", "amount", "value")
    )


def catalogue(folded: DataFrame) -> DataFrame:
    """One row per product: first known attributes and number of prices, busiest first."""
    first = [
        F.expr(f"min_by({c}, first_obs.at) filter (where {c} is not null)").alias(c)
        for c in ("name", "brand", "website")
    ]
    return (
        folded.where(F.col("product_key").isNotNull())
        .groupBy(*KEY)
        .agg(
            *first,
            F.min("ram_gb").alias("ram_gb"),
            F.min("storage_gb").alias("storage_gb"),
            F.sum("n_prices").alias("n_obs"),
        )
        .orderBy(F.desc("n_obs"), *KEY)
    )


def latest_url(folded: DataFrame) -> DataFrame:
    """URL of each product's last observation, where that one has a URL."""
    last = folded.where(F.col("product_key").isNotNull()).groupBy(*KEY).agg(
        F.max_by("URL", F.col("last_obs.at")).alias("URL")
    )
    return last.where(F.col("URL").isNotNull() & ~F.col("URL").isin("", "nan"))


def distinct_keys(folded: DataFrame) -> DataFrame:
    return folded.where(F.col("product_key").isNotNull()).select(*KEY).distinct()


def price_stats(daily: DataFrame) -> DataFrame:
    """Last, mean, lowest and highest daily price and the number of days."""
    return daily.groupBy(*KEY).agg(
        F.max_by("price", "date").alias("last_price"),
        F.avg("price").alias("avg_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.count("*").alias("n_days"),
    )


def date_bounds(daily: DataFrame) -> DataFrame:
    """First and last day of each product, beside those of its category."""
    own = daily.groupBy(*KEY).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    # Two rows, one per category. Joined by shuffle, each category would be one task.
    overall = own.groupBy("category").agg(
        F.min("first_day").alias("category_first_day"),
        F.max("last_day").alias("category_last_day"),
    )
    return own.join(F.broadcast(overall), "category")


def product_history(
    rows: DataFrame, category: str, keys: str | Iterable[str]
) -> DataFrame:
    """Rows of one or several products named by key."""
    wanted = [keys] if isinstance(keys, str) else list(keys)
    return rows.where((F.col("category") == category) & F.col("product_key").isin(wanted))


def selected_history(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows of the products in ``selection``, however many."""
    return rows.join(selection.select(*KEY), KEY, "left_semi")


def history_range(
    rows: DataFrame, start: datetime.date | str, end: datetime.date | str
) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; an inverted range is empty."""
    return rows.where(
        F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )
