"""What the physical plans may and may not contain."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from checks import queries
from pricewake.operators import catalog, forecast, ingest, model, movers, training
from pricewake.operators.features import TABLET_FEATURES
from pricewake.sources.stored import remove_folder, scratch_folder, store
from tests.helpers import daily_frame, listing, prices_frame, products_frame, series


def executed(frame) -> str:
    """The plan that ran, exchanges it reused counted once."""
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def planned(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return queries.Tables(spark, sf_dir)


def test_folding_raw_prices_sorts_nothing(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.randrange(40), rng.random(), i * 1000) for i in range(2000)]
    frame = spark.createDataFrame(rows, "obs_id long, product_id long, price double, t long")
    frame = frame.select("obs_id", "product_id", "price", F.timestamp_seconds("t").alias("timestamp"))
    frame.withColumn("date", F.to_date("timestamp")).write.parquet(str(tmp_path / "p"))
    plan = planned(ingest.fold_listings(spark.read.parquet(str(tmp_path / "p"))))
    assert "SortAggregate" not in plan and "Sort [" not in plan and "HashAggregate" in plan


@pytest.mark.parametrize(
    "report",
    [movers.market_movers, catalog.catalogue, catalog.latest_url],
    ids=["movers", "catalogue", "urls"],
)
def test_reports_sort_no_raw_row(tables, report):
    lines = planned(report(tables.folded)).splitlines()
    # Plans print from the result down: below the fold of the prices nothing is sorted.
    fold = max(i for i, line in enumerate(lines) if "Aggregate(keys=[product_id" in line)
    assert not any("Sort" in line for line in lines[fold:])


def ends_by_sorting(rows):
    """First and last price per listing, from a sort of (date, time, id)."""
    by_listing = {}
    for obs, listing_id, price, timestamp, date in rows:
        key = (date, timestamp, -(10**30) if obs is None else obs)
        by_listing.setdefault(listing_id, []).append((key, price))
    return {
        k: (min(v, key=lambda x: x[0])[1], max(v, key=lambda x: x[0])[1], len(v))
        for k, v in by_listing.items()
    }


def folded_ends(spark, rows):
    frame = spark.createDataFrame(rows, "obs_id long, product_id long, price double, t string, d string")
    typed = frame.repartition(3).select(
        "obs_id", "product_id", "price",
        F.to_timestamp("t").alias("timestamp"), F.to_date("d").alias("date"),
    )
    found = ingest.fold_listings(typed).select(
        "product_id", "first_obs.price", F.col("last_obs.price").alias("last"), "n_rows"
    )
    return {r["product_id"]: (r["price"], r["last"], r["n_rows"]) for r in found.collect()}


IDS = [None, 0, -1, -(2**63), 2**63 - 1, 5, 6, 7, 8, 9]
AGES = [
    # Times before 1970, in one microsecond, and days around them up to ten off.
    (["1969-12-31 23:59:59.999999", "1970-01-01 00:00:00", "1970-01-02 03:00:00"], ["1969-12-31", "1970-01-01", "1970-01-11", "1969-12-23"]),
    (["2024-03-01 10:00:00", "2024-03-01 10:00:00.000001", "2024-02-29 23:00:00"], ["2024-03-01", "2024-02-29", "2024-03-02"]),
    (["0001-01-01 00:00:00", "0001-01-02 05:00:00"], ["0001-01-01", "0001-01-05"]),
    (["9999-12-31 23:59:59", "9999-12-30 01:00:00"], ["9999-12-31", "9999-12-22"]),
]


def test_ends_of_a_fold_equal_a_sort(spark):
    rng = random.Random(7)
    rows, used = [], set()
    for _ in range(500):
        times, days = rng.choice(AGES)
        row = (rng.choice(IDS), rng.randrange(40), rng.choice([None, 1.0, 2.0, 3.5]), rng.choice(times), rng.choice(days))
        if (row[0], *row[3:], row[1]) not in used:
            used.add((row[0], *row[3:], row[1]))
            rows.append(row)
    assert folded_ends(spark, rows) == ends_by_sorting(rows)


def test_far_off_dates_still_lead_the_order(spark):
    rows = [
        (1, 1, 10.0, "2020-01-01 12:00:00", "2024-01-01"),
        (2, 1, 20.0, "2030-01-01 13:00:00", "2023-12-31"),
        (3, 1, 30.0, "2010-01-01 11:00:00", "2024-01-02"),
    ]
    assert folded_ends(spark, rows) == {1: (20.0, 30.0, 3)}


def test_moments_run_the_windows_once(tables):
    frame = model.moments_table(training.tablet_training_rows(tables.daily("tablet")), [*TABLET_FEATURES, "target"])
    plan = planned(frame)
    assert plan.count("Window [") == plan.count("+- Window [") <= 4
    assert "Subquery" not in plan


@pytest.mark.parametrize("name", ["mobile_features", "latest_features", "mobile_training_set"])
def test_a_stored_series_reads_no_prices_again(tables, name):
    result, _ = queries.REGISTRY[name]
    assert "lineitem" not in executed(result(tables))


def test_forecast_gathers_only_the_newest_prices(spark):
    daily = daily_frame(spark, series("a", [float(x) for x in range(1, 40)]))
    fixed = queries.FIXED_MODEL
    plan = planned(forecast.recursive_forecast(daily, fixed))
    window = next(line for line in plan.splitlines() if "Window [" in line)
    assert "collect_list" not in window


def test_cut_is_found_in_smaller_and_smaller_ranges(spark, monkeypatch):
    monkeypatch.setattr(training, "_FENCES", 3)
    rows = [r for i in range(60) for r in series(f"p{i:02d}", [1.0] * (1 + i % 5))]
    daily = daily_frame(spark, rows)
    counts = daily.groupBy("product_key", "category").agg(F.count("*").alias("n_rows"))
    total = sum(1 + i % 5 for i in range(60))
    for test_size in (0.2, 0.5, 0.99):
        cut = int(total * (1.0 - test_size))
        for few in (1, 2, 1000):
            key, _, head = training._cut_point(counts, test_size, few)
            before = sum(1 + i % 5 for i in range(60) if f"p{i:02d}" < key)
            assert before <= cut < before + 1 + int(key[1:]) % 5 and head == cut - before


def test_rows_are_given_back_when_training_fails(spark):
    from pricewake.plans import training as plans

    daily = daily_frame(spark, series("a", [1.0, 2.0]))
    with pytest.raises(ValueError):
        plans.train_daily(daily, "tablet")
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_scratch_folders_lie_in_the_shared_root_and_go(spark):
    path = scratch_folder(spark, "x")
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert path.startswith(root.rstrip("/")) and "/tmp/pricewake" not in path
    assert store(spark.range(3), path).count() == 3
    remove_folder(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_daily_rows_of_an_unlisted_product_are_dropped(spark):
    products = products_frame(spark, [listing(1)])
    prices = prices_frame(spark, [(1, 1, "2", "2024-01-01"), (2, 9, "2", "2024-01-01")])
    assert ingest.load_observations(products, prices, "tablets").count() == 1
