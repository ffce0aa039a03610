from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from pricewake.operators import catalog, movers
from pricewake.operators.daily import daily_from_days, daily_prices
from pricewake.operators.ingest import fold_products, folded_from_ends
from pricewake.streaming import rollup
from tests.helpers import listing, prices_frame, products_frame

LISTINGS = [listing(1), listing(2, name="TAB", url=None), listing(3, name="B")]
BATCHES = [
    [(1, 1, "10", "2024-01-02T10:00:00"), (2, 3, "bad", "2024-01-02T10:00:00")],
    # A day seen before, one long gone, and another listing of the same product.
    [
        (3, 1, "20", "2024-01-02T08:00:00"),
        (4, 3, "7", "2023-06-01T08:00:00"),
        (5, 2, "60", "2024-01-02T07:00:00"),
    ],
    [(6, 1, "5", "2024-01-03T08:00:00")],
]


def typed(prices):
    """The same prices as numbers and times."""
    return prices.select(
        "id", "product_id", F.try_to_number("price", F.lit("999")).cast("double").alias("price"),
        F.to_timestamp("timestamp").alias("timestamp"), F.to_date("date").alias("date"),
    )


def run(spark, source, store):
    rollup.store_days(rollup.read_new_prices(spark, source), store).awaitTermination()


def same(spark, store, source):
    products = products_frame(spark, LISTINGS)
    streamed = daily_from_days(products, rollup.stored_days(spark, store))
    whole = daily_prices(products, spark.read.parquet(source))
    key = lambda r: (r["product_key"], str(r["date"]))
    assert sorted(streamed.collect(), key=key) == sorted(whole.collect(), key=key)
    return streamed.count()


@pytest.mark.parametrize("form", [lambda x: x, typed], ids=["text", "typed"])
def test_stream_equals_batch_with_late_rows_and_reruns(spark, tmp_path, form):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for batch in BATCHES[:2]:
        form(prices_frame(spark, batch)).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):  # the second run finds nothing new
            run(spark, source, store)
    assert same(spark, store, source) == 2


def test_compaction_keeps_the_sums(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for batch in BATCHES:
        prices_frame(spark, batch).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, store)
        rollup.compact_days(spark, store)
        rollup.compact_days(spark, store)
        same(spark, store, source)
        rows = rollup.stored_days(spark, store)
        assert rows.count() == rows.select("product_id", "date").distinct().count()
    assert not list((tmp_path / "store" / "days").glob("batch=*"))
    assert len(list((tmp_path / "store" / "merged").glob("upto=*"))) == 1


def test_an_unfinished_merge_does_not_count(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for batch in BATCHES:
        prices_frame(spark, batch).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, store)
    shutil.copytree(tmp_path / "store" / "days" / "batch=0", tmp_path / "store" / "merged" / "upto=9")
    (tmp_path / "store" / "merged" / "upto=9" / "_SUCCESS").unlink()
    same(spark, store, source)


ENDS = [
    [(1, 1, "100", "2024-01-02T10:00:00"), (2, 3, "16", "2024-01-02T10:00:00"), (3, 2, "7", "2024-01-05T10:00:00")],
    # Before the first and after the last seen, at the same time with another id, and a missing last price.
    [(4, 1, "90", "2023-12-31T08:00:00"), (5, 3, "8", "2024-02-01T08:00:00"), (0, 2, "9", "2024-01-05T10:00:00"), (6, 1, "bad", "2024-03-01")],
    [(7, 1, "50", "2024-01-03T08:00:00"), (8, 3, "4", "2024-02-01T09:00:00")],
]


@pytest.mark.parametrize("form", [lambda x: x, typed], ids=["text", "typed"])
def test_reports_from_the_store_equal_the_batch(spark, tmp_path, form):
    """Movers, catalogue and latest URLs after three batches, the store compacted after each but the last."""
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    products = products_frame(spark, LISTINGS)
    for k, batch in enumerate(ENDS):
        form(prices_frame(spark, batch)).coalesce(1).write.mode("append").parquet(source)
        rollup.store_prices(rollup.read_new_prices(spark, source), store).awaitTermination()
        if k < 2:
            rollup.compact_store(spark, store)
        folded = folded_from_ends(products, rollup.stored_ends(spark, store))
        whole = fold_products(products, spark.read.parquet(source))
        assert sorted(folded.collect()) == sorted(whole.select(folded.columns).collect())
        for report in (movers.market_movers, catalog.catalogue, catalog.latest_url):
            assert report(folded).collect() == report(whole).collect()
        same(spark, store, source)
    assert movers.market_movers(folded).count() == 1


def test_repeated_and_late_observations_count_once_or_not(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    sent = [
        [(1, 1, "10", "2024-01-10T10:00:00"), (2, 1, "20", "2024-01-10T11:00:00"), (None, 1, "30", "2024-01-10T12:00:00")],
        # The first again, a new one, the one without an id again and another without an id.
        [(1, 1, "10", "2024-01-10T10:00:00"), (3, 1, "40", "2024-01-12T10:00:00"), (None, 1, "30", "2024-01-10T12:00:00"), (None, 1, "31", "2024-01-10T12:00:00")],
        [(4, 1, "50", "2024-01-20T10:00:00")],
        # Behind the delay; within it; the one before again.
        [(5, 1, "99", "2024-01-10T10:00:00"), (6, 1, "60", "2024-01-19T10:00:00"), (4, 1, "50", "2024-01-20T10:00:00")],
    ]
    for batch in sent:
        prices_frame(spark, batch).coalesce(1).write.mode("append").parquet(source)
        rollup.store_days(rollup.read_new_prices(spark, source), store, "3 days").awaitTermination()
    days = {str(r["date"]): (r["price_sum"], r["price_n"]) for r in rollup.merge_days(rollup.stored_days(spark, store)).collect()}
    assert days == {"2024-01-10": (91.0, 4), "2024-01-12": (40.0, 1), "2024-01-19": (60.0, 1), "2024-01-20": (50.0, 1)}


def test_a_store_without_its_checkpoint_is_refused(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    prices_frame(spark, BATCHES[0]).coalesce(1).write.parquet(source)
    run(spark, source, store)
    (tmp_path / "store" / "_checkpoint").rename(tmp_path / "elsewhere")
    with pytest.raises(ValueError):
        run(spark, source, store)
    assert same(spark, store, source) == 1
