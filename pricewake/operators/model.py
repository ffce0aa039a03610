"""Global least squares from distributed moments, and its coefficient table."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Eigenvalues of the correlation matrix below this share of the largest count as zero.
RCOND = 1e-10

COEFFICIENT_TABLE = T.StructType(
    [
        T.StructField("category", T.StringType(), False),
        T.StructField("position", T.IntegerType(), False),
        T.StructField("feature", T.StringType(), True),
        T.StructField("coefficient", T.DoubleType(), False),
        T.StructField("anchor", T.DateType(), True),
    ]
)


@dataclass(frozen=True)
class LinearModel:
    category: str
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    # First day that day_index counts from, for profiles with a global anchor.
    anchor: datetime.date | None = None

    def predict(self, inputs: dict[str, Column] | None = None) -> Column:
        """The prediction as a plain expression over feature columns."""
        total = F.lit(self.intercept)
        for name, weight in zip(self.features, self.coefficients, strict=True):
            column = F.col(name) if inputs is None else inputs[name]
            total = total + F.lit(weight) * column
        return total

    def to_table(self, spark: SparkSession) -> DataFrame:
        """Coefficients by position; position 0 with no feature is the intercept."""
        rows = [(self.category, 0, None, self.intercept, self.anchor)] + [
            (self.category, i, name, weight, self.anchor)
            for i, (name, weight) in enumerate(
                zip(self.features, self.coefficients, strict=True), start=1
            )
        ]
        return spark.createDataFrame(rows, COEFFICIENT_TABLE)


def save_model(model: LinearModel, spark: SparkSession, path: str) -> None:
    model.to_table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> LinearModel:
    """Model stored under ``path``; a missing path raises Spark's own error."""
    rows = spark.read.schema(COEFFICIENT_TABLE).parquet(path).orderBy("position").collect()
    if not rows:
        raise ValueError(f"no coefficients under {path}")
    head, rest = rows[0], rows[1:]
    return LinearModel(
        head.category,
        tuple(r.feature for r in rest),
        tuple(r.coefficient for r in rest),
        head.coefficient,
        head.anchor,
    )


def ols_moments(
    rows: DataFrame, columns: list[str], centre: dict[str, float] | None = None
) -> DataFrame:
    """Sums of the products of each two of ``1`` and ``columns``, as a square table.

    Row ``i`` holds the sums with column ``i`` in ``m_0 .. m_k``, place 0 being the
    constant, and the number of rows in ``n``. Each input row is fanned out
    by place, which keeps the aggregate narrow and compiled, and every task
    sends one row per place. ``centre`` is subtracted first, which keeps the
    products well conditioned.
    """
    shifted = [
        F.col(c).cast("double") - F.lit(float(centre[c]) if centre else 0.0) for c in columns
    ]
    placed = rows.select(F.array(F.lit(1.0), *shifted).alias("x")).select(
        "x", F.posexplode("x").alias("i", "xi")
    )
    return placed.groupBy("i").agg(
        *[
            F.sum(F.col("xi") * F.get("x", F.lit(j))).alias(f"m_{j}")
            for j in range(len(columns) + 1)
        ],
        F.count("*").alias("n"),
    )


def moments_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``ols_moments`` per pair of names: the mean product, with ``1`` the constant."""
    names = ["1", *columns]
    table = F.array(*[F.lit(n) for n in names])
    long = ols_moments(rows, columns).select(
        "i",
        "n",
        F.posexplode(F.array(*[f"m_{j}" for j in range(len(names))])).alias("j", "total"),
    )
    return (
        # Each pair once, and not the constant with itself.
        long.where((F.col("j") > 0) & (F.col("i") <= F.col("j")))
        .select(
            F.get(table, F.col("i")).alias("x"),
            F.get(table, F.col("j")).alias("y"),
            "n",
            (F.col("total") / F.col("n")).alias("mean_product"),
        )
    )


def solve(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Minimum-norm least-squares coefficients from centred moments.

    The inputs can be linearly dependent (the spec score is a combination of
    the two other spec columns) or constant, so the system is solved on the
    correlation scale with small eigenvalues dropped, and the result projected
    off the directions the data cannot tell apart.
    """
    scale = np.sqrt(np.diag(gram))
    # A column with no spread carries no information; its coefficient is 0.
    live = scale > 0
    if not live.any():
        return np.zeros(len(scale))
    inner = scale[live]
    values, vectors = np.linalg.eigh(gram[np.ix_(live, live)] / np.outer(inner, inner))
    kept = values > RCOND * values[-1]
    basis = vectors[:, kept]
    found = basis @ ((basis.T @ (cross[live] / inner)) / values[kept]) / inner
    blind = vectors[:, ~kept] / inner[:, None]
    if blind.size:
        directions, _ = np.linalg.qr(blind)
        found = found - directions @ (directions.T @ found)
    result = np.zeros(len(scale))
    result[live] = found
    return result


def from_moments(
    full: np.ndarray,
    centre: dict[str, float],
    features: tuple[str, ...],
    category: str,
    target: str = "target",
    anchor: datetime.date | None = None,
) -> LinearModel:
    """Model from the summed products of the constant, the features and the target, each less its ``centre``."""
    k = len(features)
    off = full[0, 1:] / full[0, 0]
    # About their means, whatever the centre was.
    full = full[1:, 1:] - np.outer(off, off) * full[0, 0]
    weights = solve(full[:k, :k], full[:k, k])
    means = np.array([centre[c] for c in (*features, target)]) + off
    intercept = float(means[k] - weights @ means[:k])
    return LinearModel(category, tuple(features), tuple(map(float, weights)), intercept, anchor)


def fit(
    rows: DataFrame,
    features: tuple[str, ...],
    category: str,
    target: str = "target",
    anchor: datetime.date | None = None,
) -> LinearModel:
    """Least squares with intercept over ``rows``.

    Two aggregations, means then centred products; only sums of the fixed
    feature count reach the driver. Persist or store ``rows`` beforehand.
    """
    columns = [*features, target]
    first = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns]).first()
    if not first["n"]:
        raise ValueError("no product meets the training requirements")
    centre = {c: first[c] for c in columns}
    full = np.empty((len(columns) + 1, len(columns) + 1))
    for line in ols_moments(rows, columns, centre).collect():
        full[line["i"]] = line[1:-1]
    return from_moments(full, centre, features, category, target, anchor)
