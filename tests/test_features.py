from __future__ import annotations

import statistics
from bisect import bisect_left, bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewake.operators import features, training
from tests.helpers import daily_frame, day, series

HAND = [
    ("2024-01-01", 100.0), ("2024-01-02", 110.0), ("2024-01-04", 90.0), ("2024-01-05", 120.0),
]


def test_hand_checked_features(spark):
    daily = daily_frame(spark, [("a", d, p) for d, p in HAND])
    rows = features.add_features(daily, features.TABLET).orderBy("date").collect()
    expected = {
        "day_index": [0, 1, 3, 4],
        "dayofweek": [0, 1, 3, 4],
        "rolling_avg_3": [100, 105, 100, 106.666667],
        "rolling_avg_7": [100, 105, 100, 105],
        "rolling_std_3": [0, 7.071068, 10, 15.275252],
        "price_lag_1": [100, 100, 110, 90],
        "price_lag_3": [100, 100, 100, 100],
        "price_lag_7": [100, 100, 100, 100],
        "pct_change_1": [0, 0.1, -0.181818, 0.333333],
        "pct_change_3": [0, 0, 0, 0.2],
        "ram_normalized": [0.25] * 4,
        "storage_normalized": [0.125] * 4,
        "specs_score": [2] * 4,
    }
    for name, values in expected.items():
        assert [r[name] for r in rows] == pytest.approx(values, abs=1e-6), name


def test_zero_base_change_is_zero(spark):
    daily = daily_frame(spark, series("a", [0.0, 50.0]))
    rows = features.add_features(daily, features.TABLET).orderBy("date").collect()
    assert rows[1]["pct_change_1"] == 0


def test_mobile_day_index_counts_from_the_first_day_of_all(spark):
    daily = daily_frame(spark, series("a", [1.0], "2024-01-01") + series("b", [1.0], "2024-01-11"))
    rows = features.add_features(daily, features.MOBILE).collect()
    assert {r["product_key"]: r["day_index"] for r in rows} == {"a": 0, "b": 10}
    fixed = features.add_features(daily, features.MOBILE, F.lit(day("2023-12-31"))).collect()
    assert {r["product_key"]: r["day_index"] for r in fixed} == {"a": 1, "b": 11}


def test_features_use_one_sort_and_no_python(spark):
    daily = daily_frame(spark, series("a", [1.0, 2.0]))
    plan = features.add_features(daily, features.TABLET)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
    assert plan.count("Exchange hash") == 1
    assert "Python" not in plan and "SinglePartition" not in plan


def window_values(prices: list[float]) -> dict[str, list[float]]:
    """Window features by their definition, from slices of the price list."""

    def last(n: int, i: int) -> list[float]:
        return prices[max(0, i - n + 1) : i + 1]

    def back(k: int, i: int) -> float | None:
        return prices[i - k] if i >= k else None

    places = range(len(prices))
    out = {f"rolling_avg_{n}": [statistics.fmean(last(n, i)) for i in places] for n in (3, 7)}
    out["rolling_std_3"] = [statistics.stdev(last(3, i)) if i else 0.0 for i in places]
    for k in (1, 3, 7):
        out[f"price_lag_{k}"] = [prices[0] if back(k, i) is None else back(k, i) for i in places]
    for k in (1, 3):
        out[f"pct_change_{k}"] = [
            (prices[i] - back(k, i)) / back(k, i) if back(k, i) else 0.0 for i in places
        ]
    return out


def _random_products(n: int, seed: int) -> dict[str, list[float]]:
    rng = np.random.default_rng(seed)
    products = {}
    for i in range(n):
        length = int(rng.integers(1, 60))
        # Few levels, so that prices repeat and differ in the last bit.
        base = 900.1 + i
        products[f"p{i:03d}"] = [
            float(base * (1 + 2 * (a - b)))
            for a, b in zip(
                rng.integers(0, 11, length) / 100, rng.integers(0, 9, length) / 100, strict=True
            )
        ]
    return products


def test_features_equal_their_definition(spark):
    products = _random_products(20, 1)
    rows = [r for key, prices in products.items() for r in series(key, prices)]
    frame = features.add_features(daily_frame(spark, rows), features.TABLET).orderBy("date")
    found: dict[str, list] = {}
    for r in frame.collect():
        found.setdefault(r["product_key"], []).append(r)
    for key, prices in products.items():
        for name, values in window_values(prices).items():
            assert [r[name] for r in found[key]] == pytest.approx(values, abs=1e-6), (key, name)


def test_trim_keeps_what_lies_in_the_band_to_the_last_bit(spark):
    products = _random_products(120, 2)
    rows = [r for key, prices in products.items() for r in series(key, prices)]
    found = training.trim_outliers(daily_frame(spark, rows)).groupBy("product_key").count()
    counts = {r["product_key"]: r["count"] for r in found.collect()}
    bands = {r["product_key"]: r for r in training.price_quantiles(daily_frame(spark, rows)).collect()}
    for key, prices in products.items():
        ordered = sorted(prices)
        low, high = np.quantile(ordered, [0.01, 0.99])
        assert (bands[key]["q_low"], bands[key]["q_high"]) == (low, high)
        assert counts.get(key, 0) == bisect_right(ordered, high) - bisect_left(ordered, low), key


def test_quantiles_of_one_to_ten(spark):
    daily = daily_frame(spark, series("a", [float(x) for x in range(1, 11)]))
    row = training.price_quantiles(daily).first()
    assert (row["q_low"], row["q_high"]) == pytest.approx((1.09, 9.91))
    kept = sorted(r["price"] for r in training.trim_outliers(daily).collect())
    assert kept == [float(x) for x in range(2, 10)]


def test_equal_prices_are_not_trimmed(spark):
    daily = daily_frame(spark, series("a", [918.102] * 7))
    assert training.trim_outliers(daily).count() == 7
