"""Market movers: price change since the first observation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewake.functions.text import egp, percent
from pricewake.operators.training import MIN_MOVER_OBS
from pricewake.schema import KEY

# Length of the two tables and of the chart.
TABLE_ROWS = 5
CHART_ROWS = 15


def market_movers(folded: DataFrame) -> DataFrame:
    """First and last price and the change between them, per product.

    Needs two observations and a positive first price; a product whose last
    price is missing has no change to report and is skipped.
    """
    ends = folded.where(F.col("product_key").isNotNull()).groupBy(*KEY).agg(
        F.sum("n_rows").alias("n_rows"),
        F.min("first_obs").alias("first_obs"),
        F.max("last_obs").alias("last_obs"),
        F.max_by(F.struct("name", "website"), "last_obs.at").alias("last_row"),
    )
    priced = ends.where(F.col("n_rows") >= MIN_MOVER_OBS).select(
        *KEY,
        F.col("last_row.name").alias("product"),
        F.upper("last_row.website").alias("website"),
        F.col("first_obs.price").alias("first_price"),
        F.col("last_obs.price").alias("last_price"),
    )
    return (
        priced.where((F.col("first_price") > 0) & F.col("last_price").isNotNull())
        .withColumn(
            "change_pct",
            (F.col("last_price") - F.col("first_price")) / F.col("first_price") * 100,
        )
        .withColumn("current_price", F.col("last_price").cast("bigint"))
    )


def mover_text(movers: DataFrame) -> DataFrame:
    """Display form of the two mover columns."""
    return movers.select(
        "product",
        "website",
        percent(F.col("change_pct")).alias("change"),
        egp(F.col("current_price")).alias("current"),
    )


def ranked_movers(movers: DataFrame, n: int = CHART_ROWS) -> DataFrame:
    """The n largest drops and the n largest rises of every category, with ``side`` and ``place``.

    Both sides come from one pass over the movers. The bound on the place is
    applied within each task first, so that no more than n rows of a category
    and side leave it, and none is sorted whole in one place.
    """
    sides = F.inline(
        F.array(
            F.struct(F.lit("drop").alias("side"), F.col("change_pct").alias("by")),
            F.struct(F.lit("rise").alias("side"), (-F.col("change_pct")).alias("by")),
        )
    )
    order = Window.partitionBy("category", "side").orderBy("by", "product_key")
    ranked = movers.select("*", sides).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= n).drop("by")


def _of_side(ranked: DataFrame, side: str, n: int) -> DataFrame:
    rows = ranked.where((F.col("side") == side) & (F.col("place") <= n))
    return rows.orderBy("category", "place").drop("side", "place")


def mover_lists(ranked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Table of drops, table of rises and rows of the bar chart from ``ranked_movers``, stored or not."""
    return (
        _of_side(ranked, "drop", TABLE_ROWS),
        _of_side(ranked, "rise", TABLE_ROWS),
        _of_side(ranked, "rise", CHART_ROWS),
    )


def top_drops(movers: DataFrame, n: int = TABLE_ROWS) -> DataFrame:
    """The n largest drops of every category; equal ones by key."""
    return _of_side(ranked_movers(movers, n), "drop", n)


def top_rises(movers: DataFrame, n: int = TABLE_ROWS) -> DataFrame:
    return _of_side(ranked_movers(movers, n), "rise", n)


def top_changes(movers: DataFrame) -> DataFrame:
    """Rows of the bar chart, per category."""
    return top_rises(movers, CHART_ROWS)
