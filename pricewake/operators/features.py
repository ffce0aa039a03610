"""Per-product time-series features over daily rows.

Frames count rows, not calendar days: a gap in the series stays a gap. A
product has at most one daily row per calendar day, which bounds every window
partition by the tracked period, however many raw observations it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pricewake.functions.calendar import calendar_fields, spec_fields
from pricewake.schema import KEY

# Model inputs in the order the coefficients are stored.
TABLET_FEATURES = (
    "day_index", "dayofweek", "day_of_month", "month",
    "rolling_avg_3", "rolling_avg_7", "rolling_std_3",
    "price_lag_1", "price_lag_3", "price_lag_7",
    "pct_change_1", "pct_change_3",
    "ram_normalized", "storage_normalized", "specs_score",
)
MOBILE_FEATURES = (
    "day_index", "dayofweek", "day_of_month", "month",
    "rolling_avg_3", "rolling_avg_7", "rolling_std_3",
    "price_lag_1", "price_lag_3", "price_lag_7",
    "ram_normalized", "storage_normalized", "specs_score",
)


@dataclass(frozen=True)
class Profile:
    """What differs between the two models."""

    category: str
    features: tuple[str, ...]
    # day_index counts from the category's first day, else from the product's own.
    global_anchor: bool


TABLET = Profile("tablet", TABLET_FEATURES, global_anchor=False)
MOBILE = Profile("mobile", MOBILE_FEATURES, global_anchor=True)
PROFILES = {p.category: p for p in (TABLET, MOBILE)}


def series_window() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy("date")


def whole_series() -> WindowSpec:
    """The full partition, in the same ordering so that one sort serves all windows."""
    return series_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _last_rows(n: int) -> WindowSpec:
    return series_window().rowsBetween(1 - n, 0)


def rolling_columns() -> dict[str, Column]:
    """Means of the last 3 and 7 rows, sample deviation of the last 3 (one row: 0)."""
    price = F.col("price")
    return {
        "rolling_avg_3": F.avg(price).over(_last_rows(3)),
        "rolling_avg_7": F.avg(price).over(_last_rows(7)),
        "rolling_std_3": F.coalesce(F.stddev_samp(price).over(_last_rows(3)), F.lit(0.0)),
    }


def lag_columns() -> dict[str, Column]:
    """Price 1, 3 and 7 rows back; before that, the product's first price."""
    price, series = F.col("price"), series_window()
    first = F.first(price).over(series)
    return {
        f"price_lag_{k}": F.coalesce(F.lag(price, k).over(series), first) for k in (1, 3, 7)
    }


def pct_change_columns() -> dict[str, Column]:
    """Relative change over 1 and 3 rows; 0 without a usable base."""
    price, series = F.col("price"), series_window()
    return {
        f"pct_change_{k}": F.coalesce(
            F.try_divide(price, F.lag(price, k).over(series)) - 1, F.lit(0.0)
        )
        for k in (1, 3)
    }


def global_anchor(daily: DataFrame) -> Column:
    """First day of the whole frame, as a scalar subquery."""
    return daily.agg(F.min("date")).scalar()


def day_index(anchor: Column | None = None) -> Column:
    start = F.min("date").over(whole_series()) if anchor is None else anchor
    return F.datediff("date", start)


def add_features(
    daily: DataFrame, profile: Profile, anchor: Column | None = None
) -> DataFrame:
    """All model inputs of ``profile`` beside the daily columns, from one sort.

    ``anchor`` overrides the first day of a global-anchor profile, as when a
    stored model brings its own.
    """
    if profile.global_anchor and anchor is None:
        anchor = global_anchor(daily)
    columns = {
        "day_index": day_index(anchor if profile.global_anchor else None),
        **calendar_fields(F.col("date")),
        **rolling_columns(),
        **lag_columns(),
        **pct_change_columns(),
        **spec_fields(F.col("ram_gb"), F.col("storage_gb")),
    }
    return daily.select("*", *[columns[name].alias(name) for name in profile.features])
