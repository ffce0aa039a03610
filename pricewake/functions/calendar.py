"""Calendar and device-spec features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_fields(date: Column) -> dict[str, Column]:
    """Weekday with Monday 0, day of month, month."""
    return {
        "dayofweek": F.weekday(date),
        "day_of_month": F.dayofmonth(date),
        "month": F.month(date),
    }


def spec_fields(ram_gb: Column, storage_gb: Column) -> dict[str, Column]:
    return {
        "ram_normalized": ram_gb / F.lit(16.0),
        "storage_normalized": storage_gb / F.lit(1024.0),
        "specs_score": ram_gb / F.lit(4.0) + storage_gb / F.lit(128.0),
    }
