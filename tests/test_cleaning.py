from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from pricewake.functions import text
from pricewake.operators import ingest, signals
from pricewake.operators.daily import daily_prices
from pricewake.plans import training as plans
from pricewake.schema import resolve_category
from tests.helpers import listing, prices_frame, products_frame


@pytest.mark.parametrize(
    ("price", "expected"),
    [
        ("12.5", 12.5), (" 7 ", 7.0), ("1e3", 1000.0), ("abc", None), ("", None),
        ("NaN", None), (None, None), ("12d", None), ("3.5F", None), ("1,200", None),
    ],
)
def test_price_coercion(spark, price, expected):
    rows = ingest.clean_prices(
        prices_frame(spark, [(1, 1, price, "2024-01-01")]), keep_missing_price=True
    )
    assert rows.first()["price"] == expected


@pytest.mark.parametrize(
    ("stamp", "expected"),
    [
        ("2024-01-01T10:20:30.123456+02:00", datetime.datetime(2024, 1, 1, 8, 20, 30, 123456)),
        ("2024-01-01T10:20:30Z", datetime.datetime(2024, 1, 1, 10, 20, 30)),
        ("2024-01-01", datetime.datetime(2024, 1, 1)),
        ("20240102", datetime.datetime(2024, 1, 2)),
        ("20240102T030405", datetime.datetime(2024, 1, 2, 3, 4, 5)),
        ("bad", None), ("12:30", None), (None, None),
    ],
)
def test_timestamp_coercion(spark, stamp, expected):
    rows = ingest.clean_prices(prices_frame(spark, [(1, 1, "5", stamp, None)]))
    # As text in the session zone, which is UTC.
    found = rows.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")).collect()
    assert [r[0] for r in found] == (
        [expected.strftime("%Y-%m-%d %H:%M:%S.%f")] if expected else []
    )


def test_missing_prices_are_kept_on_request_only(spark):
    prices = prices_frame(spark, [(1, 1, "abc", "2024-01-01"), (2, 1, "5", "2024-01-01")])
    assert ingest.clean_prices(prices).count() == 1
    assert ingest.clean_prices(prices, keep_missing_price=True).count() == 2


def test_stored_date_can_differ_from_timestamp(spark):
    prices = prices_frame(spark, [(1, 1, "5", "2024-01-01T23:00:00", "2024-02-02")])
    assert str(ingest.clean_prices(prices).first()["date"]) == "2024-01-01"
    assert str(ingest.clean_prices(prices, stored_date=True).first()["date"]) == "2024-02-02"


@pytest.mark.parametrize(("raw", "gb"), [("8.7", 8), (None, 0), ("n/a", 0), ("16", 16)])
def test_ram_truncates_and_defaults(spark, raw, gb):
    rows = ingest.tracked_products(products_frame(spark, [listing(1, ram=raw)]))
    assert rows.first()["ram_gb"] == gb


def test_product_key_trims_the_name_only(spark):
    rows = ingest.tracked_products(
        products_frame(
            spark,
            [listing(1, name="\t Galaxy TAB  \n"), listing(2, name=None), listing(3, website=" X")],
        )
    )
    keys = {r["product_id"]: r["product_key"] for r in rows.collect()}
    assert keys == {1: "galaxy tab shopa 4 64", 2: None, 3: "tab  x 4 64"}


def test_only_active_listings_of_the_category(spark):
    products = products_frame(
        spark,
        [
            listing(1),
            listing(2, is_active=False),
            listing(3, is_active=None),
            listing(4, category="mobile"),
            listing(5, category="watch"),
        ],
    )
    assert [r["id"] for r in ingest.active_products(products, "tablet").collect()] == [1]
    assert {r["id"] for r in ingest.active_products(products).collect()} == {1, 4}


def test_category_labels():
    assert resolve_category("Tablets") == "tablet"
    assert resolve_category("Mobile Phones") == "mobile"
    with pytest.raises(ValueError):
        resolve_category("laptops")


def test_daily_roll_up_takes_first_attributes_and_last_url(spark):
    # Two listings with one key: attributes come from the one seen first.
    products = products_frame(
        spark,
        [
            listing(1, name="TAB", brand="late", url=None),
            listing(2, name="Tab", brand="early", url="two"),
        ],
    )
    prices = prices_frame(
        spark,
        [
            (1, 1, "10", "2024-01-01T12:00:00"),
            (2, 2, "20", "2024-01-01T09:00:00"),
            (3, 2, "bad", "2024-01-01T08:00:00"),
            (4, 1, "40", "2024-01-03T08:00:00"),
        ],
    )
    rows = {str(r["date"]): r for r in daily_prices(products, prices).collect()}
    assert set(rows) == {"2024-01-01", "2024-01-03"}
    first = rows["2024-01-01"]
    assert first["price"] == 15
    assert (first["brand"], first["name"], first["URL"]) == ("early", "Tab", "two")
    assert rows["2024-01-03"]["URL"] is None


def test_empty_inputs_keep_the_schema(spark):
    products, prices = products_frame(spark, []), prices_frame(spark, [])
    empty = daily_prices(products, prices, "tablet")
    assert empty.count() == 0
    assert {"price", "name", "URL", "date"} <= set(empty.columns)
    assert ingest.load_observations(products, prices).count() == 0


def test_title_case_and_number_text(spark):
    row = (
        spark.createDataFrame([("o-neil mac'S", 1234.5, 0.25, -0.4)], "s string, a double, b double, c double")
        .select(
            text.title_case(F.col("s")).alias("t"),
            text.egp(F.col("a")).alias("e"),
            text.signed_percent(F.col("b")).alias("p"),
            text.signed_percent(F.col("c")).alias("m"),
        )
        .first()
    )
    assert row["t"] == "o-neil mac'S".title()
    assert row["e"] == f"EGP {1234.5:,.0f}"
    assert row["p"] == f"{0.25:+.1f}%"
    assert row["m"] == f"{-0.4:+.1f}%"


def test_percent_and_amount_texts(spark):
    values = [999.95, 1234.56, -1234.56, -0.0, 0.0, -0.04, 0.25, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        text.percent(F.col("v")), text.signed_percent(F.col("v")), text.signed_egp(F.col("v")), text.egp(F.col("v"))
    )
    assert [tuple(r) for r in rows.collect()] == [
        ("1000.0%", "+1000.0%", "+1,000 EGP", "EGP 1,000"),
        ("1234.6%", "+1234.6%", "+1,235 EGP", "EGP 1,235"),
        ("-1234.6%", "-1234.6%", "-1,235 EGP", "EGP -1,235"),
        ("-0.0%", "-0.0%", "-0 EGP", "EGP -0"),
        ("0.0%", "+0.0%", "+0 EGP", "EGP 0"),
        ("-0.0%", "-0.0%", "-0 EGP", "EGP -0"),
        ("0.2%", "+0.2%", "+0 EGP", "EGP 0"),
        (None, None, None, None),
    ]


def test_signal_texts_are_the_stated_ones():
    assert signals.TREND_TEXT["buy"] == ("💰 Buy Opportunity", "Price expected to drop")
    assert signals.TREND_TEXT["wait"] == ("⏳ Wait Before Buying", "Price expected to rise")
    assert signals.TREND_TEXT["neutral"] == ("📊 Stable Price", "Price expected to stay stable")
    assert signals.SIGNAL_TEXT["volatile"] == ("⚠️", "CAUTION - HIGH PRICE VOLATILITY")
    assert signals.SIGNAL_TEXT["buy"] == ("💰", "EXCELLENT BUYING OPPORTUNITY")
    assert signals.SIGNAL_TEXT["wait"] == ("⏳", "NOT RECOMMENDED - PRICE RISING")
    assert signals.SIGNAL_TEXT["hold"] == ("📊", "STABLE PRICING - BUY ANYTIME")


def test_every_loader_resolves_or_refuses_a_category(spark):
    products = products_frame(spark, [listing(1), listing(2, category="mobile")])
    prices = prices_frame(spark, [(1, 1, "10", "2024-01-01T10:00:00"), (2, 2, "10", "2024-01-01T10:00:00")])
    loaders = [
        lambda c: ingest.active_products(products, c),
        lambda c: ingest.semi_join_prices(products, prices, c),
        lambda c: ingest.load_observations(products, prices, c),
        lambda c: ingest.fold_products(products, prices, c),
        lambda c: daily_prices(products, prices, c),
    ]
    for load in loaders:
        assert load("tablets").count() == load("Mobile Phones").count() == 1
        with pytest.raises(ValueError):
            load("laptops")
    with pytest.raises(ValueError):
        plans.train(products, prices, "laptops")
