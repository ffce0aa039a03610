"""The two page-level reports as batch jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewake.operators import catalog, movers
from pricewake.operators.features import PROFILES, add_features
from pricewake.operators.forecast import chart_series, forecast_bands, recursive_forecast
from pricewake.operators.ingest import fold_products
from pricewake.operators.model import LinearModel
from pricewake.operators.signals import product_summary, with_signal_text
from pricewake.sources.stored import store


@dataclass(frozen=True)
class MarketInsights:
    movers: DataFrame
    drops: DataFrame
    rises: DataFrame
    chart: DataFrame


def market_insights(
    products: DataFrame,
    prices: DataFrame,
    category: str | None = None,
    folder: str | None = None,
) -> MarketInsights:
    """The movers page of one category or, a list each, of all.

    With a ``folder`` the largest changes are stored there, so that one pass
    over the prices serves the three lists.
    """
    table = movers.market_movers(fold_products(products, prices, category))
    ranked = movers.ranked_movers(table)
    return MarketInsights(table, *movers.mover_lists(store(ranked, folder) if folder else ranked))


@dataclass(frozen=True)
class ForecastPage:
    summary: DataFrame
    bands: DataFrame
    chart: DataFrame
    urls: DataFrame


def forecast_page(
    products: DataFrame,
    prices: DataFrame,
    daily: DataFrame,
    model: LinearModel,
) -> ForecastPage:
    """Everything the forecast page shows, for every product of the model's category."""
    folded = fold_products(products, prices, model.category)
    own = daily.where(F.col("category") == model.category)
    results = recursive_forecast(own, model)
    anchor = F.lit(model.anchor) if model.anchor else None
    featured = add_features(own, PROFILES[model.category], anchor)
    return ForecastPage(
        with_signal_text(product_summary(catalog.catalogue(folded), results)),
        forecast_bands(results),
        chart_series(featured, results),
        catalog.latest_url(folded),
    )
