from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pricewake.operators.appended import CARRIED, append_days, fit_window, series_tail, store_moments
from pricewake.operators.features import MOBILE, TABLET, add_features
from pricewake.operators.model import fit
from tests.helpers import daily_frame, day, files_read, series


def market(spark):
    """Products of many, few and one row, one that begins late and one with gaps."""
    rng = random.Random(3)
    rows = []
    for k, n in enumerate([30, 12, 8, 7, 6, 3, 1]):
        start = day("2024-03-01") - datetime.timedelta(days=n - 1)
        rows += series(f"p{k}", [rng.uniform(5, 90) for _ in range(n)], start.isoformat(), 4 + k, 64 * (k + 1))
    rows += [("gap", f"2024-{m:02d}-01", 10.0 * m) for m in (1, 2, 3)] + series("new", [3.0, 4.0], "2024-02-29")
    return daily_frame(spark, rows)


@pytest.mark.parametrize("profile", [TABLET, MOBILE], ids=["own", "global"])
def test_appended_days_equal_the_whole_computation(spark, profile):
    daily = market(spark)
    anchor = daily.agg(F.min("date")).first()[0] if profile.global_anchor else None
    whole = add_features(daily, profile, None if anchor is None else F.lit(anchor))
    cut = day("2024-02-28")
    tail = series_tail(daily.where(F.col("date") < F.lit(cut)))
    for k in range(3):
        today = F.col("date") == F.lit(cut + datetime.timedelta(days=k))
        found, tail = append_days(tail, daily.where(today), profile, anchor)
        tail = spark.createDataFrame(tail.collect(), tail.schema)
        expected = {r["product_key"]: r for r in whole.where(today).collect()}
        rows = found.collect()
        assert len(rows) == len(expected) > 0
        for r in rows:
            for name in profile.features:
                assert r[name] == pytest.approx(expected[r["product_key"]][name], abs=1e-9), (r["product_key"], name)
        assert tail.groupBy("product_key").count().agg(F.max("count")).first()[0] <= CARRIED


def test_several_days_at_once_and_an_empty_start(spark):
    daily = market(spark)
    empty = series_tail(daily.limit(0))
    found, tail = append_days(empty, daily, TABLET)
    assert sorted(found.select(*add_features(daily, TABLET).columns).collect()) == sorted(add_features(daily, TABLET).collect())
    assert sorted(tail.collect()) == sorted(series_tail(daily).collect())
    nothing, same = append_days(tail, daily.limit(0), TABLET)
    assert nothing.count() == 0 and sorted(same.collect()) == sorted(tail.collect())


def test_a_day_that_does_not_follow_raises(spark):
    daily = market(spark)
    found, _ = append_days(series_tail(daily), daily.where("product_key = 'p0'").limit(1), TABLET)
    with pytest.raises(Exception, match="not after the carried days"):
        found.collect()
    with pytest.raises(ValueError, match="anchor"):
        append_days(series_tail(daily), daily, MOBILE)


def test_refit_equals_a_fit_of_the_window(spark, tmp_path):
    """Days are added, replaced and left out; days outside the window are not read."""
    rows = add_features(market(spark), TABLET).withColumn("target", F.col("price") * 1.5 + F.col("rolling_avg_7"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    path, cut = str(tmp_path / "m"), F.lit(day("2024-02-28"))
    store_moments(rows.where(F.col("date") < cut), path, TABLET.features)
    new = rows.where(F.col("date") >= cut)
    for _ in range(2):  # again, as after a failure
        store_moments(new, path, TABLET.features)
    for start, end in [(None, None), (day("2024-02-10"), None), (day("2024-02-05"), day("2024-02-29"))]:
        window = rows.where((F.col("date") >= F.lit(start or day("2000-01-01"))) & (F.col("date") <= F.lit(end or day("2100-01-01"))))
        expected = fit(window, TABLET.features, "tablet")
        found = fit_window(spark, path, TABLET.features, "tablet", start, end)
        assert found.coefficients == pytest.approx(expected.coefficients, rel=1e-5, abs=1e-6)
        assert found.intercept == pytest.approx(expected.intercept, rel=1e-5, abs=1e-6)
    days = spark.read.parquet(f"{path}/days").where(F.col("date") >= cut)
    assert "PartitionFilters: [" in (plan := days._jdf.queryExecution().executedPlan().toString()) and "date#" in plan
    assert files_read(days) < files_read(spark.read.parquet(f"{path}/days")) / 4
    with pytest.raises(ValueError, match="no rows"):
        fit_window(spark, path, TABLET.features, "tablet", day("2030-01-01"))
