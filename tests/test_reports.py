from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricewake.operators import catalog, movers, signals
from pricewake.operators.ingest import fold_products, load_observations, semi_join_prices
from tests.helpers import daily_frame, listing, prices_frame, products_frame, series


@pytest.fixture(scope="module")
def market(spark):
    products = products_frame(
        spark,
        [
            listing(1, name="Drop A"), listing(2, name="drop B", brand="o-neil"),
            listing(3, name="Single"), listing(4, name="Zero"), listing(5, name="Gone", url=None),
            listing(6, name="Rise", website="ShopB", ram=None, storage="512"),
            listing(7, name="Off", is_active=False), listing(8, name=None),
            listing(9, name="Unseen", brand="never"),
            # The same product listed twice.
            listing(10, name="Twin", url="old", brand=None), listing(11, name="TWIN", url="", brand="x"),
        ],
    )
    prices = prices_frame(
        spark,
        [
            (1, 1, "100", "2024-01-01"), (2, 1, "80", "2024-01-05"), (3, 1, "1", "2024-01-03"),
            (4, 2, "50", "2024-01-01T08:00:00"), (5, 2, "40", "2024-01-01T09:00:00"),
            (6, 3, "5", "2024-01-01"),
            (7, 4, "0", "2024-01-01"), (8, 4, "50", "2024-01-02"),
            (9, 5, "100", "2024-01-01"), (10, 5, "bad", "2024-01-02"),
            (11, 6, "10", "2024-01-01"), (12, 6, "15.9", "2024-01-02"),
            (13, 7, "1", "2024-01-01"), (14, 7, "2", "2024-01-02"),
            (15, 8, "1", "2024-01-01"), (16, 8, "2", "2024-01-02"),
            (17, 10, "10", "2024-01-01"), (18, 11, "11", "2024-01-02"),
        ],
    )
    return products, prices, fold_products(products, prices)


def _keys(frame) -> list[str]:
    return [r["product_key"] for r in frame.collect()]


def test_movers(market):
    found = {r["product"]: r for r in movers.market_movers(market[2]).collect()}
    assert set(found) == {"Drop A", "drop B", "Rise", "TWIN"}
    assert found["Drop A"]["change_pct"] == -20
    assert found["drop B"]["change_pct"] == -20
    assert (found["Rise"]["website"], found["Rise"]["current_price"]) == ("SHOPB", 15)
    assert found["TWIN"]["change_pct"] == pytest.approx(10)


def test_top_lists_break_ties_by_key(market):
    table = movers.market_movers(market[2])
    assert _keys(movers.top_drops(table, 2)) == ["drop a shopa 4 64", "drop b shopa 4 64"]
    assert _keys(movers.top_rises(table, 1)) == ["rise shopb 0 512"]
    mixed = table.unionByName(table.withColumn("category", F.lit("mobile")))
    assert _keys(movers.top_drops(mixed, 1)) == ["drop a shopa 4 64"] * 2
    assert [r["category"] for r in movers.top_changes(mixed).collect()] == ["mobile"] * 4 + ["tablet"] * 4
    plan = movers.ranked_movers(mixed, 3)._jdf.queryExecution().executedPlan().toString()
    # Bounded before the exchange and after it.
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Final" in plan
    text = {r["product"]: r for r in movers.mover_text(table).collect()}
    assert (text["Rise"]["change"], text["Rise"]["current"]) == ("59.0%", "EGP 15")


def test_catalogue_counts_prices_not_rows(market):
    rows = {r["product_key"]: r for r in catalog.catalogue(market[2]).collect()}
    assert rows["gone shopa 4 64"]["n_obs"] == 1
    twin = rows["twin shopa 4 64"]
    assert (twin["name"], twin["brand"], twin["n_obs"]) == ("Twin", "x", 2)
    assert "unseen shopa 4 64" not in rows
    assert None not in rows


def test_latest_url_is_that_of_the_last_row(market):
    rows = {r["product_key"]: r["URL"] for r in catalog.latest_url(market[2]).collect()}
    assert rows["drop a shopa 4 64"] == "u"
    assert "twin shopa 4 64" not in rows  # its last listing has an empty one
    assert "gone shopa 4 64" not in rows


def test_search_is_a_regular_expression(market):
    names = lambda term, **k: {
        r["name"] for r in catalog.search(market[2], term, **k).collect()
    }
    assert names("DROP") == {"Drop A", "drop B"}
    assert names("^drop .$|rise") == {"Drop A", "drop B", "Rise"}
    assert names("^drop .$", literal=True) == set()
    assert None in names("")
    with pytest.raises(Exception, match="(?i)pattern|regex"):
        names("(")


def test_facets(market):
    rows = catalog.facet_values(catalog.search(market[2], "drop|rise")).collect()
    values = {}
    for r in rows:
        values.setdefault(r["facet"], []).append(r["value"])
    assert values == {
        "brand": ["b", "o-neil"],
        "website": ["ShopA", "ShopB"],
        "ram_gb": ["0", "4"],
        "storage_gb": ["64", "512"],
    }
    picked = catalog.facet_filter(market[2], websites=["ShopA", "ShopB"], rams=[0])
    assert _keys(picked) == ["rise shopb 0 512"]
    assert catalog.facet_filter(market[2]).count() == market[2].count()


def test_history_of_products_and_ranges(market):
    products, prices, _ = market
    rows = load_observations(products, prices)
    assert catalog.product_history(rows, "tablet", "drop a shopa 4 64").count() == 3
    both = ["drop a shopa 4 64", "rise shopb 0 512"]
    assert catalog.product_history(rows, "tablet", both).count() == 5
    picked = catalog.catalogue(market[2]).where(F.col("product_key").isin(both))
    assert catalog.selected_history(rows, picked).count() == 5
    ranged = catalog.history_range(rows, "2024-01-02", "2024-01-03").collect()
    assert sorted(r["obs_id"] for r in ranged) == [3, 8, 10, 12, 16, 18]
    assert catalog.history_range(rows, "2024-01-03", "2024-01-02").count() == 0


def test_semi_join_leaves_out_inactive_listings(market):
    products, prices, _ = market
    assert semi_join_prices(products, prices, "tablet").count() == 16
    assert semi_join_prices(products, prices, "mobile").count() == 0


def test_price_stats_and_bounds(spark):
    daily = daily_frame(spark, series("a", [3.0, 1.0, 2.0]) + series("b", [5.0], "2024-02-01"))
    stats = {r["product_key"]: r for r in catalog.price_stats(daily).collect()}["a"]
    assert (stats["last_price"], stats["avg_price"], stats["min_price"], stats["max_price"]) == (
        2, 2, 1, 3,
    )
    bounds = {r["product_key"]: r for r in catalog.date_bounds(daily).collect()}["b"]
    assert str(bounds["first_day"]) == "2024-02-01"
    assert str(bounds["category_first_day"]) == "2024-01-01"


@pytest.mark.parametrize(
    ("last", "future", "mae", "signal", "trend"),
    [
        (100.0, 90.0, 11.0, "volatile", "buy"),
        (100.0, 97.5, 1.0, "buy", "neutral"),
        (100.0, 98.0, 1.0, "hold", "neutral"),
        (100.0, 103.0, 1.0, "wait", "neutral"),
        (100.0, 104.0, 10.0, "wait", "wait"),
        (0.0, 5.0, 1.0, None, None),
    ],
)
def test_signals(spark, last, future, mae, signal, trend):
    rows = spark.createDataFrame(
        [(last, future, mae)], "last_price double, forecast_price double, mae double"
    )
    row = signals.with_signal_text(signals.with_buy_signal(signals.with_trend(rows))).first()
    assert (row["signal"], row["trend"]) == (signal, trend)
    if signal == "buy":
        assert row["signal_desc"] == f"AI model predicts a {2.5:.1f}% price drop"
        assert row["signal_detail"].endswith(f"EGP {2.5:,.0f}")


@pytest.mark.parametrize(("n", "tier"), [(14, "Low"), (15, "Medium"), (29, "Medium"), (30, "High")])
def test_confidence(spark, n, tier):
    assert spark.range(1).select(signals.confidence_tier(F.lit(n))).first()[0] == tier


def test_summary_joins_cards_with_results(spark, market):
    results = spark.createDataFrame(
        [("tablet", "drop b shopa 4 64", 40.0, 44.0, 1.0, 20)],
        "category string, product_key string, last_price double, forecast_price double, "
        "mae double, n_days long",
    )
    card = signals.product_summary(catalog.catalogue(market[2]), results)
    row = card.first()
    assert (row["brand"], row["website"], row["confidence"]) == ("O-Neil", "SHOPA", "Medium")
    assert (row["signal"], row["change"]) == ("wait", 4.0)
    shown = signals.compare_products(card).first()
    assert (shown["current_text"], shown["change_text"]) == ("EGP 40", "+10.0%")
