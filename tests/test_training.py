from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricewake.operators import features, metrics, model, training
from pricewake.operators.forecast import score
from pricewake.plans import training as plans
from pricewake.sources import sample_tables
from tests.helpers import daily_frame, series
from tests.test_features import _random_products


@pytest.mark.parametrize(
    ("n", "head"), [(1, 0), (10, 8), (11, 8), (14, 11), (15, 12), (29, 23), (30, 24)]
)
def test_per_product_split(spark, n, head):
    daily = daily_frame(spark, series("a", [1.0] * n))
    split = training.per_product_split(daily).orderBy("date").collect()
    assert [r["is_train"] for r in split] == [True] * head + [False] * (n - head)


@pytest.mark.parametrize("sizes", [[1], [3, 4], [5, 1, 1, 8], [1] * 600, [7] * 40 + [200] + [2] * 30])
def test_global_split_matches_row_numbers(spark, sizes):
    rows = [r for i, n in enumerate(sizes) for r in series(f"k{i:04d}", [1.0] * n)]
    split = training.global_split(daily_frame(spark, rows)).orderBy("product_key", "date")
    flags = [r["is_train"] for r in split.collect()]
    cut = int(len(rows) * (1 - 0.2))
    assert flags == [True] * cut + [False] * (len(rows) - cut)


def test_global_split_of_nothing(spark):
    assert training.global_split(daily_frame(spark, [])).count() == 0


def test_next_price_drops_the_last_row(spark):
    rows = training.next_price_target(daily_frame(spark, series("a", [1.0, 2.0, 3.0])))
    assert [(r["price"], r["target"]) for r in rows.orderBy("date").collect()] == [
        (1.0, 2.0), (2.0, 3.0),
    ]


def _gate(prices: list[float], min_obs: int = 10) -> bool:
    p = pd.Series(prices)
    cut = int(len(p) * 0.8)
    head, tail = p[:cut], p[cut:]
    high, low = head.quantile(0.99), head.quantile(0.01)
    inside = lambda x: ((x >= low) & (x <= high)).sum()
    return bool(
        inside(head) >= min_obs
        and inside(tail) > 0
        and len(p) - 1 >= min_obs
        and 0 < int((len(p) - 1) * 0.8) < len(p) - 1
    )


def test_mobile_gate_against_pandas(spark):
    products = _random_products(80, 3)
    rows = [r for key, prices in products.items() for r in series(key, prices)]
    found = training.mobile_gate(daily_frame(spark, rows)).select("product_key", "gate_open").distinct()
    flags = {r["product_key"]: r["gate_open"] for r in found.collect()}
    assert flags == {key: _gate(prices) for key, prices in products.items()}
    assert len(set(flags.values())) == 2


def test_mobile_test_rows_see_their_training_context(spark):
    products = _random_products(30, 4)
    rows = [r for key, prices in products.items() for r in series(key, prices)]
    found = training.mobile_training_set(daily_frame(spark, rows)).toPandas()
    for key, prices in products.items():
        mine = found[found.product_key == key].sort_values("date")
        if not _gate(prices):
            assert mine.empty
            continue
        p = pd.Series(prices[:-1])
        cut = int(len(p) * 0.8)
        assert list(mine["is_train"]) == [True] * cut + [False] * (len(p) - cut)
        assert list(mine["target"]) == prices[1:]
        context = p[max(0, cut - 7) :]
        tail = context.rolling(7, min_periods=1).mean()[-(len(p) - cut) :]
        assert np.allclose(mine[~mine["is_train"]]["rolling_avg_7"], tail)


def _dense(spark, n: int = 400, seed: int = 5) -> tuple:
    rng = np.random.default_rng(seed)
    ram = rng.choice([4, 8, 16], n)
    storage = rng.choice([64, 128, 512], n)
    x = np.column_stack(
        [rng.normal(1000, 50, n), ram / 16, storage / 1024, ram / 4 + storage / 128, np.full(n, 3.0)]
    )
    y = 5 + 0.9 * x[:, 0] + 7 * x[:, 3] + rng.normal(0, 1, n)
    names = ("price_lag_1", "ram_normalized", "storage_normalized", "specs_score", "flat")
    frame = spark.createDataFrame(
        [tuple(map(float, (*row, t))) for row, t in zip(x, y, strict=True)],
        ", ".join(f"{c} double" for c in (*names, "target")),
    )
    return frame, names, x, y


def test_fit_is_the_minimum_norm_solution(spark):
    frame, names, x, y = _dense(spark)
    found = model.fit(frame, names, "tablet")
    centred = x - x.mean(axis=0)
    weights, *_ = np.linalg.lstsq(centred, y - y.mean(), rcond=None)
    assert np.allclose(found.coefficients, weights, atol=1e-8)
    assert found.intercept == pytest.approx(y.mean() - weights @ x.mean(axis=0), abs=1e-6)


def test_residuals_are_orthogonal_to_the_inputs(spark):
    frame, names, x, y = _dense(spark)
    scored = score(frame, model.fit(frame, names, "tablet"))
    residual = np.array([r[0] for r in scored.select(F.col("target") - F.col("prediction")).collect()])
    centred = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-9)
    assert abs(residual.mean()) < 1e-9
    assert np.abs(centred.T @ residual / len(y)).max() < 1e-8


def test_fit_of_nothing_raises(spark):
    frame, names, *_ = _dense(spark, 5)
    with pytest.raises(ValueError):
        model.fit(frame.where("target is null"), names, "tablet")


def test_model_round_trip(spark, tmp_path):
    frame, names, *_ = _dense(spark, 50)
    found = model.fit(frame, names, "mobile", anchor=__import__("datetime").date(2024, 1, 1))
    model.save_model(found, spark, str(tmp_path / "m"))
    assert model.load_model(spark, str(tmp_path / "m")) == found


def test_missing_model_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        model.load_model(spark, str(tmp_path / "none"))


def test_metrics_edge_cases(spark):
    frame = spark.createDataFrame(
        [("one", 1.0, 2.0), ("flat", 5.0, 5.0), ("flat", 5.0, 5.0), ("off", 5.0, 5.0), ("off", 5.0, 6.0)],
        "k string, target double, prediction double",
    )
    found = {r["k"]: r for r in metrics.regression_metrics(frame, ["k"]).collect()}
    assert found["one"]["r2"] is None and found["one"]["mae"] == 1
    assert found["flat"]["r2"] == 1 and found["off"]["r2"] == 0


def test_gap_flag(spark):
    def gap(test_error):
        frame = spark.createDataFrame(
            [(True, 0.0, 1.0), (False, 0.0, test_error)],
            "is_train boolean, target double, prediction double",
        )
        return metrics.mae_gap(frame).first()["gap"]

    assert gap(3.0) == "healthy"
    assert gap(3.1) == "large_gap"


@pytest.mark.parametrize("category", ["tablet", "mobile"])
def test_training_from_the_tables(spark, sf_dir, category):
    products = sample_tables.products(spark, sf_dir)
    prices = sample_tables.price_history(spark, sf_dir)
    trained = plans.train(products, prices, category)
    profile = features.TABLET if category == "tablet" else features.MOBILE
    rows = trained.rows.toPandas()
    if category == "tablet":
        rows = rows.sort_values(["product_key", "date"])
        rows["is_train"] = np.arange(len(rows)) < int(len(rows) * 0.8)
    head = rows[rows.is_train]
    x = head[list(profile.features)].to_numpy(float)
    y = head["target"].to_numpy(float)
    weights, *_ = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=None)
    assert np.allclose(trained.model.coefficients, weights, atol=1e-6)
    report = {r["is_train"]: r for r in trained.metrics.collect()}
    assert report[True]["n_rows"] == len(head)
    assert report[False]["n_rows"] == len(rows) - len(head)
    assert trained.gap.first()["gap"] in ("healthy", "large_gap")
    trained.release()


def test_unknown_category(spark, sf_dir):
    with pytest.raises(ValueError):
        plans.train(
            sample_tables.products(spark, sf_dir), sample_tables.price_history(spark, sf_dir), "watch"
        )
