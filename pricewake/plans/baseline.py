"""A forecast SQL can express, to check signals and bands apart from the fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewake.operators.features import lag_columns, rolling_columns
from pricewake.operators.forecast import HORIZON_DAYS
from pricewake.schema import KEY


def baseline_forecast(daily: DataFrame, days: int = HORIZON_DAYS) -> DataFrame:
    """The last 7-row mean on every future day; MAE of predicting the previous price."""
    scored = daily.withColumn("level", rolling_columns()["rolling_avg_7"]).withColumn(
        "previous", lag_columns()["price_lag_1"]
    )
    per_product = scored.groupBy(*KEY).agg(
        F.max("date").alias("last_date"),
        F.max_by("price", "date").alias("last_price"),
        F.max_by("level", "date").alias("forecast_price"),
        F.avg(F.abs(F.col("price") - F.col("previous"))).alias("mae"),
        F.count("*").alias("n_days"),
    )
    path = F.transform(
        F.sequence(F.lit(1), F.lit(days)),
        lambda i: F.struct(
            F.date_add("last_date", i).alias("date"), F.col("forecast_price").alias("price")
        ),
    )
    return per_product.withColumn("forecast", path)
