"""Small frames built by hand."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from pricewake.schema import PRICE_HISTORY, PRODUCTS

DAILY = (
    "category string, product_key string, date date, price double, ram_gb int, storage_gb int"
)


def day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


def daily_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (product_key, date text, price[, ram, storage]) as a tablet series."""
    full = [("tablet", r[0], day(r[1]), r[2], *(r[3:] or (4, 128))) for r in rows]
    return spark.createDataFrame(full, DAILY)


def series(key: str, prices: list[float], start: str = "2024-01-01", *specs) -> list[tuple]:
    first = day(start)
    return [
        (key, (first + datetime.timedelta(days=i)).isoformat(), p, *specs)
        for i, p in enumerate(prices)
    ]


def listing(id, name="Tab", website="ShopA", ram="4", storage="64", url="u", **more):
    row = {
        "id": id, "category": "tablet", "is_active": True, "name": name, "brand": "b",
        "website": website, "ram_gb": ram, "storage_gb": storage, "url": url,
    }
    return {**row, **more}


def products_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[f] for f in PRODUCTS.names) for r in rows], PRODUCTS)


def prices_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (id, product_id, price text, timestamp text[, date text])."""
    full = [r if len(r) == 5 else (*r, r[3] and r[3][:10]) for r in rows]
    return spark.createDataFrame(full, PRICE_HISTORY)


def files_read(frame) -> int:
    """Files that the scans of a frame opened, in a first run of its plan."""
    frame = frame.select("*")
    frame.collect()
    plan, found = frame._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            found.append(node.metrics().apply("numFiles").value())
        for inner in ("executedPlan", "plan"):
            if name == "AdaptiveSparkPlan" and inner == "executedPlan" or name.endswith("QueryStage") and inner == "plan":
                return walk(getattr(node, inner)())
        children = node.children()
        for i in range(children.length()):
            walk(children.apply(i))

    walk(plan)
    return max(found)
