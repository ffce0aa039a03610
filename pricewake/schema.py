"""Input schemas and the names every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

# The device categories a listing can belong to.
CATEGORIES = ("tablet", "mobile")

# A product is identified by its text key inside one category. The key comes
# first: it tells rows apart at once when they are sorted by product.
KEY = ["product_key", "category"]

# Listing attributes carried from `products`.
ATTRIBUTES = ["name", "brand", "website", "ram_gb", "storage_gb", "URL"]

PRODUCTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("name", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("website", T.StringType()),
        T.StructField("ram_gb", T.StringType()),
        T.StructField("storage_gb", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

PRICE_HISTORY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("price", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("date", T.StringType()),
    ]
)


def resolve_category(label: str) -> str:
    """Category named by a free label such as ``"tablets"`` or ``"Mobile Phones"``."""
    for category in CATEGORIES:
        if category in label.lower():
            return category
    raise ValueError(f"no device category in {label!r}; expected one of {CATEGORIES}")
