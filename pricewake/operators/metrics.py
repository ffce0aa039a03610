"""Regression metrics as one-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a test error beyond this multiple of the training error is a warning.
GAP_LIMIT = 3.0


def metric_columns(actual: Column, predicted: Column) -> dict[str, Column]:
    """MAE, RMSE and R2. A constant target scores 1 when met exactly, else 0."""
    error = predicted - actual
    residual = F.sum(error * error)
    spread = F.var_pop(actual) * F.count(actual)
    return {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "r2": F.when(F.count(actual) < 2, F.lit(None))
        .when(spread == 0, F.when(residual == 0, 1.0).otherwise(0.0))
        .otherwise(1 - F.try_divide(residual, spread)),
    }


def regression_metrics(
    scored: DataFrame, by: list[str], actual: str = "target", predicted: str = "prediction"
) -> DataFrame:
    columns = metric_columns(F.col(actual), F.col(predicted))
    return scored.groupBy(*by).agg(
        F.count(actual).alias("n_rows"), *[c.alias(name) for name, c in columns.items()]
    )


def mae_gap(
    scored: DataFrame, actual: str = "target", predicted: str = "prediction"
) -> DataFrame:
    """Test over training MAE and whether that gap is healthy, in one row."""
    error = F.abs(F.col(predicted) - F.col(actual))
    train = F.avg(F.when(F.col("is_train"), error))
    test = F.avg(F.when(~F.col("is_train"), error))
    return scored.agg(train.alias("train_mae"), test.alias("test_mae")).withColumn(
        "gap_ratio", F.try_divide("test_mae", "train_mae")
    ).withColumn(
        "gap", F.when(F.col("gap_ratio") > GAP_LIMIT, "large_gap").otherwise("healthy")
    )
