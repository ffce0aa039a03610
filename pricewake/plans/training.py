"""Training jobs: from the two input tables to a stored model and its report."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewake.operators import training
from pricewake.operators.daily import daily_prices
from pricewake.operators.features import MOBILE, TABLET, Profile
from pricewake.operators.forecast import score
from pricewake.operators.metrics import mae_gap, regression_metrics
from pricewake.operators.model import LinearModel, fit
from pricewake.operators.training import MIN_OBS, TEST_SIZE
from pricewake.schema import resolve_category
from pricewake.sources.snapshot import MAX_AGE_SECONDS, load_or_refresh
from pricewake.sources.stored import remove_folder, store


@dataclass(frozen=True)
class Trained:
    model: LinearModel
    # Training rows, persisted or stored in ``folder``; the reports below read them.
    rows: DataFrame
    scored: DataFrame
    metrics: DataFrame
    gap: DataFrame
    folder: str | None = None

    def release(self) -> LinearModel:
        """Give the kept rows back and keep the model."""
        _give_back(self.rows, self.folder)
        return self.model


def _kept(rows: DataFrame, folder: str | None) -> DataFrame:
    """Rows that several aggregations read: stored in ``folder`` or, without one, persisted.

    A stored table survives lost executors; of persisted rows a lost share is
    recomputed from the lineage.
    """
    return store(rows, folder) if folder else rows.persist(StorageLevel.MEMORY_AND_DISK)


def _give_back(kept: DataFrame, folder: str | None) -> None:
    if folder:
        remove_folder(kept.sparkSession, folder)
    else:
        kept.unpersist()


def _finish(kept: DataFrame, folder: str | None, split, profile: Profile, anchor=None) -> Trained:
    """Fit on ``split(kept)``; the kept rows are given back if that fails."""
    try:
        parts = split(kept)
        model = fit(parts.where("is_train"), profile.features, profile.category, anchor=anchor)
    except Exception:
        _give_back(kept, folder)
        raise
    scored = score(parts, model)
    return Trained(
        model,
        kept,
        scored,
        regression_metrics(scored, ["category", "is_train"]),
        mae_gap(scored),
        folder,
    )


def train_tablet(
    daily: DataFrame,
    min_obs: int = MIN_OBS,
    test_size: float = TEST_SIZE,
    folder: str | None = None,
) -> Trained:
    rows = _kept(training.tablet_training_rows(daily, min_obs), folder)
    return _finish(rows, folder, lambda kept: training.global_split(kept, test_size), TABLET)


def train_mobile(
    daily: DataFrame,
    anchor_day: datetime.date | None = None,
    min_obs: int = MIN_OBS,
    test_size: float = TEST_SIZE,
    folder: str | None = None,
) -> Trained:
    if anchor_day is None:
        anchor_day = daily.agg(F.min("date")).first()[0]
    rows = training.mobile_training_set(daily, min_obs, test_size, F.lit(anchor_day))
    return _finish(_kept(rows, folder), folder, lambda kept: kept, MOBILE, anchor_day)


def loaded_daily(
    products: DataFrame,
    prices: DataFrame,
    folder: str,
    category: str | None = None,
    max_age: float = MAX_AGE_SECONDS,
) -> DataFrame:
    """The daily series of one or all categories, computed anew only when its stored version has expired."""
    name = "all" if category is None else resolve_category(category)
    return load_or_refresh(
        products.sparkSession, f"{folder}/{name}", lambda: daily_prices(products, prices, category), max_age
    )


def train(products: DataFrame, prices: DataFrame, category: str, **options) -> Trained:
    """Train the model of one category, named by any label, from the input tables."""
    return train_daily(daily_prices(products, prices, category), category, **options)


def train_daily(daily: DataFrame, category: str, **options) -> Trained:
    """Train the model of one category from its daily series, best a stored one.

    The series is read once for the training rows and, by the mobile recipe, once
    more for its first day.
    """
    category = resolve_category(category)
    own = daily.where(F.col("category") == category)
    if category == TABLET.category:
        return train_tablet(own, **options)
    anchor_day = own.agg(F.min("date")).first()[0]
    if anchor_day is None:
        raise ValueError(f"no {category} observations to train on")
    return train_mobile(own, anchor_day, **options)
