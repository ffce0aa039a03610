from __future__ import annotations

import json

import datetime

import pytest
from pyspark.sql import functions as F

from pricewake.operators.daily import daily_prices
from pricewake.schema import PRICE_HISTORY, PRODUCTS
from pricewake.sources import tables
from pricewake.operators.catalog import history_range, product_history
from pricewake.plans.training import loaded_daily
from pricewake.sources import snapshot
from pricewake.sources.series import read_selected, read_series, store_series
from pricewake.sources.snapshot import load_or_refresh
from tests.helpers import files_read, listing, prices_frame, products_frame


def test_json_and_csv_follow_the_stated_schema(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(json.dumps(listing(i)) for i in (1, 2)))
    (tmp_path / "h.csv").write_text(
        "id,product_id,price,timestamp,date\n1,1,10,2024-01-01,2024-01-01\n2,2,x,2024-01-01,\n"
    )
    products = tables.read_products(spark, str(tmp_path / "p.json"), "json")
    prices = tables.read_price_history(spark, str(tmp_path / "h.csv"), "csv")
    assert products.schema == PRODUCTS
    assert prices.schema == PRICE_HISTORY
    assert daily_prices(products, prices).count() == 1
    counts = {r["table_name"]: r["n_rows"] for r in tables.scan_counts(products, prices).collect()}
    assert counts == {"products": 2, "price_history": 2}


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_columnar_formats(spark, tmp_path, fmt):
    products_frame(spark, [listing(1)]).write.format(fmt).save(str(tmp_path / fmt))
    assert tables.read_products(spark, str(tmp_path / fmt), fmt).count() == 1


def test_bad_requests(spark):
    with pytest.raises(ValueError):
        tables.read_table(spark, "x", "xml")
    with pytest.raises(ValueError):
        tables.read_table(spark, "x", "csv")
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:x", "t", "id", 5, 5, 4)


def test_jdbc_read_is_partitioned_by_range():
    options = tables.jdbc_options("jdbc:x", "t", "id", 0, 100, 4, {"fetchsize": "5", "user": "u"})
    assert options["partitionColumn"] == "id"
    assert options["numPartitions"] == "4"
    assert options["fetchsize"] == "5"


def test_snapshot_is_reused_until_it_expires(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    path = str(tmp_path / "snap")
    first = load_or_refresh(spark, path, build, now=1_000_000)
    again = load_or_refresh(spark, path, build, now=1_003_599)
    assert (first.count(), again.count(), len(built)) == (1, 1, 1)
    fresh = load_or_refresh(spark, path, build, now=1_003_600)
    assert (fresh.count(), len(built)) == (2, 2)
    assert first.count() == 1  # an open reader keeps its own


def test_a_refresh_does_not_disturb_readers(spark, tmp_path):
    """A reader that began before, and one that begins while a version is being written, see whole versions."""
    path = str(tmp_path / "snap")
    snapshot.refresh(spark, path, lambda: spark.range(100), now=1.0)
    began = load_or_refresh(spark, path, lambda: pytest.fail(), now=2.0)
    seen = []

    def build():
        # In the middle of the refresh the old version is the one to read.
        seen.append(spark.read.parquet(snapshot.current_version(spark, path)[0]).count())
        return spark.range(7)

    snapshot.refresh(spark, path, build, now=3.0)
    assert seen == [100] and began.count() == 100
    assert load_or_refresh(spark, path, lambda: pytest.fail(), now=4.0).count() == 7

    def broken():
        return spark.range(5).select(F.raise_error(F.lit("no")).alias("id"))

    with pytest.raises(Exception, match="no"):
        snapshot.refresh(spark, path, broken, now=5.0)
    assert load_or_refresh(spark, path, lambda: pytest.fail(), now=6.0).count() == 7


def test_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "snap")
    for k in range(5):
        snapshot.refresh(spark, path, lambda k=k: spark.range(k), now=float(k))
    assert len(list((tmp_path / "snap" / "versions").iterdir())) == snapshot.KEPT_VERSIONS
    assert load_or_refresh(spark, path, lambda: pytest.fail(), now=4.0).count() == 4


def test_plans_read_a_stored_version(spark, tmp_path):
    products, folder = products_frame(spark, [listing(1)]), str(tmp_path / "loads")
    first = loaded_daily(products, prices_frame(spark, [(1, 1, "5", "2024-01-01")]), folder, "Tablets")
    again = loaded_daily(products, prices_frame(spark, []), folder, "tablet")
    assert again.collect() == first.collect() and first.count() == 1
    assert loaded_daily(products, prices_frame(spark, []), folder, "tablet", max_age=0).count() == 0


def test_series_reads_only_what_is_asked_for(spark, tmp_path):
    path = str(tmp_path / "series")
    rows = [
        (c, f"p{k}", datetime.date(2024, m, d), float(k + m), 4, 64)
        for c in ("tablet", "mobile") for k in range(12) for m in (1, 2, 3, 4) for d in (1, 15, 28)
    ]
    daily = spark.createDataFrame(rows, "category string, product_key string, date date, price double, ram_gb int, storage_gb int")
    store_series(daily, path, shards=4)
    whole = read_series(spark, path, shards=4)
    assert sorted(whole.collect()) == sorted(daily.collect())
    every = files_read(whole)

    ranged = read_series(spark, path, "2024-02-15", "2024-03-14", shards=4)
    assert sorted(ranged.collect()) == sorted(history_range(daily, "2024-02-15", "2024-03-14").collect())
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(month#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert files_read(ranged) <= every // 2

    one = read_series(spark, path, products=[("tablet", "p3")], shards=4)
    assert sorted(one.collect()) == sorted(product_history(daily, "tablet", "p3").collect())
    assert files_read(one) < every // 2 and "EqualTo(product_key,p3)" in one._jdf.queryExecution().executedPlan().toString()
    assert read_series(spark, path, products=[], shards=4).count() == 0

    chosen = daily.where("product_key = 'p5' and category = 'mobile'")
    picked = read_selected(spark, path, chosen, "2024-02-01", shards=4)
    assert sorted(picked.collect()) == sorted(daily.where("product_key = 'p5' and category = 'mobile' and date >= '2024-02-01'").select(picked.columns).collect())
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert files_read(picked) < every // 2


def test_snapshot_equals_the_computed_table(spark, tmp_path):
    products = products_frame(spark, [listing(1)])
    prices = prices_frame(spark, [(1, 1, "5", "2024-01-01"), (2, 1, "7", "2024-01-01")])
    daily = daily_prices(products, prices)
    stored = load_or_refresh(spark, str(tmp_path / "d"), lambda: daily)
    assert stored.collect() == daily.collect()


def test_persisted_equals_recomputed(spark):
    daily = daily_prices(
        products_frame(spark, [listing(1)]), prices_frame(spark, [(1, 1, "5", "2024-01-01")])
    )
    plain = daily.collect()
    kept = daily.persist()
    assert kept.collect() == plain
    kept.unpersist()


def test_balanced_predicates_split_skewed_keys_evenly(spark):
    """Ids with huge gaps; equal steps would put nearly all rows into one part."""
    ids = [*range(1000), *(10**9 + 7 * k for k in range(9000))]
    rows = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long")
    step = (max(ids) - min(ids)) / 8
    assert max(sum(int((i - min(ids)) // step) == k for i in ids) for k in range(9)) >= 9000 - 1
    predicates = tables.balanced_predicates(ids[::37], "id", 8)
    sizes = [rows.where(p).count() for p in predicates]
    assert len(sizes) == 8 and sum(sizes) == len(ids) + 1 and max(sizes) < 1.3 * len(ids) / 8
    # Every row meets exactly one condition.
    matched = sum((F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in predicates), F.lit(0))
    assert rows.select(matched.alias("m")).distinct().collect() == [(1,)]


def test_balanced_predicates_at_the_edges(spark):
    assert tables.balanced_predicates([], "id", 4) == ["1 = 1"]
    assert tables.balanced_predicates([5, 5, 5], "id", 4) == ["1 = 1"]
    assert tables.balanced_predicates([1, 2], "id", 2) == ["id < 2 or id is null", "id >= 2"]
    with pytest.raises(ValueError):
        tables.balanced_predicates([1], "id", 0)
    assert tables.key_sample_query("t", "id", 1_000_000, 10) == "select id from t where mod(id, 1000) = 0"
