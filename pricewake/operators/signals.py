"""Confidence tiers, trend and buy signals, summaries and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewake.functions.text import egp, percent, signed_egp, signed_percent, title_case
from pricewake.schema import KEY

# Decision thresholds.
HIGH_CONFIDENCE_OBS = 30
MEDIUM_CONFIDENCE_OBS = 15
TREND_LIMIT_PCT = 3
SIGNAL_LIMIT_PCT = 2
VOLATILITY_LIMIT_PCT = 10

# Trend signal -> (headline, explanation).
TREND_TEXT = {
    "buy": ("💰 Buy Opportunity", "Price expected to drop"),
    "wait": ("⏳ Wait Before Buying", "Price expected to rise"),
    "neutral": ("📊 Stable Price", "Price expected to stay stable"),
}

# Buy signal -> (icon, headline).
SIGNAL_TEXT = {
    "volatile": ("⚠️", "CAUTION - HIGH PRICE VOLATILITY"),
    "buy": ("💰", "EXCELLENT BUYING OPPORTUNITY"),
    "wait": ("⏳", "NOT RECOMMENDED - PRICE RISING"),
    "hold": ("📊", "STABLE PRICING - BUY ANYTIME"),
}


def change_pct(last: Column, future: Column) -> Column:
    """Change from ``last`` to ``future`` in percent; NULL on a zero base."""
    return F.try_divide(future - last, last) * 100


def confidence_tier(n_obs: Column) -> Column:
    return (
        F.when(n_obs >= HIGH_CONFIDENCE_OBS, "High")
        .when(n_obs >= MEDIUM_CONFIDENCE_OBS, "Medium")
        .otherwise("Low")
    )


def trend_signal(change: Column) -> Column:
    """A drop beyond the limit says buy, a rise wait; the limit itself is neutral."""
    return (
        F.when(change < -TREND_LIMIT_PCT, "buy")
        .when(change > TREND_LIMIT_PCT, "wait")
        .when(change.isNotNull(), "neutral")
    )


def buy_signal(change: Column, volatility: Column) -> Column:
    """Volatility is checked first, then the direction of the forecast."""
    return (
        F.when(volatility > VOLATILITY_LIMIT_PCT, "volatile")
        .when(change < -SIGNAL_LIMIT_PCT, "buy")
        .when(change > SIGNAL_LIMIT_PCT, "wait")
        .when(change.isNotNull(), "hold")
    )


def with_trend(forecasts: DataFrame) -> DataFrame:
    """Adds ``trend_pct`` and ``trend`` from ``last_price`` and ``forecast_price``."""
    return forecasts.withColumn(
        "trend_pct", change_pct(F.col("last_price"), F.col("forecast_price"))
    ).withColumn("trend", trend_signal(F.col("trend_pct")))


def with_buy_signal(forecasts: DataFrame) -> DataFrame:
    """Adds ``change_pct``, ``volatility_pct`` and ``signal``."""
    return (
        forecasts.withColumn(
            "change_pct", change_pct(F.col("last_price"), F.col("forecast_price"))
        )
        .withColumn("volatility_pct", F.try_divide("mae", "last_price") * 100)
        .withColumn("signal", buy_signal(F.col("change_pct"), F.col("volatility_pct")))
    )


def _lookup(signal: Column, texts: dict[str, tuple[str, ...]], part: int) -> Column:
    table = F.create_map(*[F.lit(x) for key, row in texts.items() for x in (key, row[part])])
    return table[signal]


def with_trend_text(forecasts: DataFrame) -> DataFrame:
    return forecasts.withColumn(
        "trend_text", _lookup(F.col("trend"), TREND_TEXT, 0)
    ).withColumn("trend_desc", _lookup(F.col("trend"), TREND_TEXT, 1))


def with_signal_text(signals: DataFrame) -> DataFrame:
    """Display texts of the buy signal."""
    signal, size = F.col("signal"), percent(F.abs("change_pct"))
    gap = egp(F.abs(F.col("forecast_price") - F.col("last_price")))
    # Wording per signal.
    description = (
        F.when(
            signal == "volatile",
            F.concat(
                F.lit("Price fluctuations detected (±"), percent(F.col("volatility_pct")), F.lit(")")
            ),
        )
        .when(signal == "buy", F.concat(F.lit("AI model predicts a "), size, F.lit(" price drop")))
        .when(
            signal == "wait",
            F.concat(F.lit("Price expected to increase by "), size, F.lit(" in next 7 days")),
        )
        .when(
            signal == "hold",
            F.concat(F.lit("Price expected to remain steady (±"), size, F.lit(")")),
        )
    )
    detail = (
        F.when(
            signal == "volatile",
            F.lit("💡 Monitor for a few more days before making a decision"),
        )
        .when(signal == "buy", F.concat(F.lit("✓ Best time to buy - Expected savings: "), gap))
        .when(
            signal == "wait",
            F.concat(F.lit("⚠️ Wait for price to stabilize - Expected cost increase: "), gap),
        )
        .when(
            signal == "hold",
            F.concat(
                F.lit("✓ Safe to purchase now - Low volatility (±"),
                F.format_number("mae", 0),
                F.lit(" EGP)"),
            ),
        )
    )
    return (
        signals.withColumn("signal_icon", _lookup(signal, SIGNAL_TEXT, 0))
        .withColumn("signal_title", _lookup(signal, SIGNAL_TEXT, 1))
        .withColumn("signal_desc", description)
        .withColumn("signal_detail", detail)
    )


def product_summary(catalogue: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One card per product: labels, current and forecast price, change, confidence."""
    results = forecasts.select(*KEY, "last_price", "forecast_price", "mae", "n_days")
    cards = catalogue.select(
        *KEY,
        "name",
        title_case(F.col("brand")).alias("brand"),
        "ram_gb",
        "storage_gb",
        F.upper("website").alias("website"),
    ).join(results, KEY)
    return (
        with_buy_signal(cards)
        .withColumn("change", F.col("forecast_price") - F.col("last_price"))
        .withColumn("confidence", confidence_tier(F.col("n_days")))
    )


def compare_products(summary: DataFrame) -> DataFrame:
    """Comparison rows, numbers and their display form; filter ``summary`` by key first."""
    return summary.select(
        *KEY,
        F.col("name").alias("product"),
        "last_price",
        "forecast_price",
        "change_pct",
        "confidence",
        egp(F.col("last_price")).alias("current_text"),
        egp(F.col("forecast_price")).alias("forecast_text"),
        signed_percent(F.col("change_pct")).alias("change_text"),
        signed_egp(F.col("change")).alias("amount_text"),
    )
