"""Every operator as a query over the sample tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.shape import Shape, shape, shape_frame
from pricewake.functions.calendar import calendar_fields, spec_fields
from pricewake.operators import (
    appended,
    catalog,
    features,
    forecast,
    ingest,
    metrics,
    model,
    movers,
    signals,
    training,
)
from pricewake.operators.daily import daily_means, daily_prices
from pricewake.plans import training as plans
from pricewake.plans.baseline import baseline_forecast
from pricewake.session import configure
from pricewake.sources import sample_tables
from pricewake.sources.series import read_selected, read_series, store_series
from pricewake.sources.stored import remove_folder, scratch_folder, store
from pricewake.sources.tables import scan_counts
from pricewake.streaming import rollup

# Inputs of the interactive operators.
SEARCH_TERM = "RED.*brand#1|^ *blue"
FACETS = {
    "brands": ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"],
    "websites": ["Shop0", "Shop2"],
    "rams": [0, 8, 16],
    "storages": [128, 512],
}
HISTORY_FROM, HISTORY_TO = "1996-01-01", "1998-12-31"
# Of the events, every so many-th is sent at the very end; the store waits so many days.
LATE_EVERY, LATE_DAYS = 7, 2

# Stated coefficients, so that a forecast can be checked apart from any fit.
FIXED_MODEL = model.LinearModel(
    "tablet",
    features.TABLET_FEATURES,
    (0.05, 0.2, -0.1, 0.3, 0.25, 0.15, -0.05, 0.4, 0.1, 0.05, 3.0, -2.0, 1.5, -0.7, 0.2),
    12.0,
)
FIXED_MOBILE_MODEL = model.LinearModel(
    "mobile",
    features.MOBILE_FEATURES,
    (0.02, 0.3, 0.1, -0.2, 0.3, 0.2, 0.1, 0.25, 0.15, 0.05, 2.0, 1.0, -0.5),
    5.0,
)


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def products(self) -> DataFrame:
        return sample_tables.products(self.spark, self.sf_dir)

    @cached_property
    def prices(self) -> DataFrame:
        return sample_tables.price_history(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return sample_tables.event_prices(self.spark, self.sf_dir)

    @cached_property
    def observations(self) -> DataFrame:
        return ingest.load_observations(self.products, self.prices)

    @cached_property
    def folded(self) -> DataFrame:
        return ingest.fold_products(self.products, self.prices)

    def daily(self, category: str | None = None) -> DataFrame:
        return daily_prices(self.products, self.prices, category)

    @cached_property
    def _stored(self) -> dict[str | None, DataFrame]:
        return {}

    def stored(self, category: str | None = None) -> DataFrame:
        """Daily series of one or all categories, computed once for what reads it more than once."""
        if category not in self._stored:
            # Without the texts, which nothing that reads this needs.
            columns = [*training.KEY, "date", "price", "ram_gb", "storage_gb"]
            daily = self.daily(category).select(*columns)
            self._stored[category] = store(daily, self.folder("daily"))
        return self._stored[category]

    def memoised(self) -> DataFrame:
        """Daily series loaded twice, the second time from the version stored by the first."""
        folder = self.folder("loads")
        for _ in range(2):
            daily = plans.loaded_daily(self.products, self.prices, folder)
        return daily

    @cached_property
    def series(self) -> str:
        """Folder of the daily series, stored for reads of a part of it."""
        path = self.folder("series")
        store_series(self.daily().select(*training.KEY, "date", "price"), path)
        return path

    def last_days(self, n: int) -> tuple[DataFrame, DataFrame]:
        """Tablet series up to, and from, its last n days."""
        daily = self.stored("tablet")
        cut = min(r["date"] for r in daily.select("date").distinct().orderBy(F.desc("date")).limit(n).collect())
        return daily.where(F.col("date") < F.lit(cut)), daily.where(F.col("date") >= F.lit(cut))

    def appended(self) -> DataFrame:
        """Features of the last three days, one day after the other, from what was carried."""
        old, new = self.last_days(3)
        tail = store(appended.series_tail(old), self.folder("tail"))
        found = []
        for day in sorted(r["date"] for r in new.select("date").distinct().collect()):
            rows, tail = appended.append_days(tail, new.where(F.col("date") == F.lit(day)), features.TABLET)
            tail = store(tail, self.folder("tail"))
            found.append(store(rows, self.folder("appended")))
        return reduce(DataFrame.unionByName, found)

    def refitted(self) -> DataFrame:
        """Coefficients after the last two days were added to the moments of the days before."""
        path, profile = self.folder("moments"), features.TABLET
        old, new = self.last_days(2)
        target = F.col("price").alias("target")
        appended.store_moments(
            features.add_features(old, profile).select("*", target), path, profile.features
        )
        rows, _ = appended.append_days(appended.series_tail(old), new, profile)
        appended.store_moments(rows.select("*", target), path, profile.features)
        found = appended.fit_window(self.spark, path, profile.features, profile.category)
        remove_folder(self.spark, path)
        return found.to_table(self.spark)

    def price_store(self) -> str:
        """Prices sent in three batches and folded as they came, the first two compacted."""
        source, path = self.folder("sent"), self.folder("price-store")
        for k in range(3):
            part = self.prices.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k)
            part.write.mode("append").parquet(source)
            rollup.store_prices(rollup.read_new_prices(self.spark, source), path).awaitTermination()
            if k == 1:
                rollup.compact_store(self.spark, path)
        remove_folder(self.spark, source)
        return path

    @cached_property
    def refolded(self) -> DataFrame:
        """What ``folded`` holds, from the store."""
        path = self.price_store()
        ends = ingest.merge_ends(rollup.stored_ends(self.spark, path))
        kept = store(ends, self.folder("ends"))
        remove_folder(self.spark, path)
        return ingest.folded_from_ends(self.products, kept)

    def late_days(self) -> DataFrame:
        """Event means per listing and day from a source that repeats and delays observations.

        First come all events of the earlier half but every ``LATE_EVERY``-th, then
        the later half with a third of the first batch again, last the ones held
        back and the whole second batch again.
        """
        source, path = self.folder("sent"), self.folder("late-store")
        events = self.events
        first, last = events.agg(F.min("timestamp"), F.max("timestamp")).first()
        half = F.col("timestamp") < F.lit(first + (last - first) / 2)
        held = (F.col("id") % LATE_EVERY == 0) & (
            F.col("timestamp") < F.lit(last - datetime.timedelta(days=2 * LATE_DAYS))
        )
        again = half & ~held & (F.col("id") % 3 == 0)
        for sent in ([half & ~held], [~half & ~held, again], [held, ~half & ~held]):
            for part in sent:
                events.where(part).write.mode("append").parquet(source)
            arrived = rollup.read_new_prices(self.spark, source)
            rollup.store_days(arrived, path, f"{LATE_DAYS} days").awaitTermination()
        days = store(rollup.merge_days(rollup.stored_days(self.spark, path)), self.folder("days"))
        for done in (source, path):
            remove_folder(self.spark, done)
        return days.select(
            "product_id",
            "date",
            F.try_divide("price_sum", "price_n").alias("price"),
            F.col("price_n").alias("n_obs"),
            F.col("first_ts").alias("timestamp"),
        )

    def folder(self, name: str) -> str:
        return scratch_folder(self.spark, name)

    @cached_property
    def lag_scored(self) -> DataFrame:
        """Daily rows with the previous price as the prediction."""
        split = training.per_product_split(self.daily())
        return split.withColumn("prediction", features.lag_columns()["price_lag_1"])

    @cached_property
    def baseline(self) -> DataFrame:
        return baseline_forecast(self.daily())

    @cached_property
    def summary(self) -> DataFrame:
        return signals.product_summary(catalog.catalogue(self.folded), self.baseline)

    def trained(self, category: str) -> plans.Trained:
        if None in self._stored:
            return plans.train_daily(self.stored(), category)
        if category == "tablet" and category not in self._stored:
            # This recipe reads the series once.
            return plans.train(self.products, self.prices, category)
        return plans.train_daily(self.stored(category), category)

    def model(self, category: str) -> model.LinearModel:
        return self.trained(category).release()


def _with_windows(daily: DataFrame, *columns: dict) -> DataFrame:
    every = {n: c for group in columns for n, c in group.items()}
    return daily.select("*", *[c.alias(n) for n, c in every.items()])


def _coefficients(t: Tables, category: str) -> DataFrame:
    return t.model(category).to_table(t.spark)


def _model_roundtrip(t: Tables) -> DataFrame:
    path = t.folder("model")
    model.save_model(t.model("mobile"), t.spark, path)
    loaded = model.load_model(t.spark, path)
    remove_folder(t.spark, path)
    return loaded.to_table(t.spark)


def _score_in_sample(t: Tables) -> DataFrame:
    trained = t.trained("mobile")
    scored = store(trained.scored, t.folder("scored"))
    trained.release()
    return scored


def _of_both(t: Tables, report: Callable[[plans.Trained], DataFrame]) -> DataFrame:
    """A small report of each category's training, read before its rows are given back."""
    parts = []
    # One pass over the prices serves both categories.
    t.stored()
    for category in features.PROFILES:
        trained = t.trained(category)
        rows = report(trained).withColumn("category", F.lit(category))
        parts.append(t.spark.createDataFrame(rows.collect(), rows.schema))
        trained.release()
    return parts[0].unionByName(parts[1])


def _training_reports(t: Tables) -> DataFrame:
    tablet = training.tablet_report(t.daily("tablet")).withColumn("category", F.lit("tablet"))
    mobile = training.training_report(t.daily("mobile")).withColumn("category", F.lit("mobile"))
    return tablet.unionByName(mobile)


def _recursive(t: Tables, category: str = "tablet") -> DataFrame:
    return forecast.recursive_forecast(t.stored(category), t.model(category))


def _forecast_export(t: Tables) -> DataFrame:
    path = t.folder("forecast")
    bands = forecast.forecast_bands(_recursive(t))
    forecast.write_forecast_csv(bands, path)
    names = forecast.forecast_export(bands).schema
    # The partition column comes back last.
    fields = [f for f in names.fields if f.name != "category"] + [names["category"]]
    return t.spark.read.schema(type(names)(fields)).option("header", "true").csv(path)


_KEY = {"category": "=", "product_key": "="}
_LABELS = {"name": "=", "brand": "=", "website": "=", "ram_gb": "i", "storage_gb": "i"}
_OBSERVATION = shape(
    **_KEY, obs_id="l", price="r", timestamp="t", date="d", **_LABELS, URL="="
)
_ROLLING = {"rolling_avg_3": "r", "rolling_avg_7": "r", "rolling_std_3": "r"}
_LAGS = {"price_lag_1": "r", "price_lag_3": "r", "price_lag_7": "r"}
_CHANGES = {"pct_change_1": "r", "pct_change_3": "r"}
_CALENDAR = {"dayofweek": "i", "day_of_month": "i", "month": "i"}
_SPECS = {"ram_normalized": "r", "storage_normalized": "r", "specs_score": "r"}
TABLET_SHAPE = {"day_index": "i", **_CALENDAR, **_ROLLING, **_LAGS, **_CHANGES, **_SPECS}
MOBILE_SHAPE = {"day_index": "i", **_CALENDAR, **_ROLLING, **_LAGS, **_SPECS}
_DAY = {**_KEY, "date": "d", "price": "r"}
_MOVER = shape(
    **_KEY, product="=", website="=", first_price="r", last_price="r", change_pct="r",
    current_price="l",
)
_BANDS = shape(**_KEY, step="i", date="d", price="r", lower="r", upper="r")
_METRICS = {"n_rows": "l", "mae": "r", "rmse": "r", "r2": "r"}
_FORECAST_DAY = shape(
    **_KEY, last_date="d", last_price="r", step="i", date="d", forecast="r", mae="r", r2="r",
    avg_price="r", min_price="r", max_price="r", n_days="l", confidence="=", trend="=",
    trend_pct="r",
)
_COEFFICIENTS = shape(category="=", position="i", feature="=", coefficient="s", anchor="d")
_POINTS = shape(**_KEY, series="=", date="d", value="r")


def _forecast_days(results: DataFrame) -> DataFrame:
    days = results.select("*", F.posexplode("forecast").alias("position", "day"))
    return days.select(
        *[c for c in results.columns if c != "forecast"],
        (F.col("position") + 1).alias("step"),
        F.col("day.date").alias("date"),
        F.col("day.price").alias("forecast"),
    )


# name -> (result, output shape)
REGISTRY: dict[str, tuple[Callable[[Tables], DataFrame], Shape]] = {
    # Sources, filters, projections.
    "scan_counts": (
        lambda t: scan_counts(t.products, t.prices),
        shape(table_name="=", n_rows="l"),
    ),
    "active_products": (
        lambda t: ingest.active_products(t.products),
        shape(id="l", category="=", name="=", brand="=", website="="),
    ),
    "clean_observations": (lambda t: t.observations, _OBSERVATION),
    "product_key": (
        lambda t: ingest.tracked_products(t.products),
        shape(product_id="l", **_KEY, ram_gb="i", storage_gb="i"),
    ),
    "semi_join_prices": (
        lambda t: ingest.semi_join_prices(t.products, t.prices),
        shape(id="l", product_id="l", price="r", date="d"),
    ),
    "search_products": (
        lambda t: catalog.search(t.observations, SEARCH_TERM),
        _OBSERVATION,
    ),
    "facet_filter": (
        lambda t: catalog.facet_filter(t.observations, **FACETS),
        _OBSERVATION,
    ),
    "facet_values": (
        lambda t: catalog.facet_values(catalog.search(t.folded, SEARCH_TERM)),
        shape(category="=", facet="=", value="="),
    ),
    "product_history": (
        # The three busiest products of the catalogue, as many as can be compared.
        lambda t: catalog.selected_history(
            t.observations, catalog.catalogue(t.folded).limit(3)
        ),
        _OBSERVATION,
    ),
    "history_range": (
        lambda t: catalog.history_range(t.daily(), HISTORY_FROM, HISTORY_TO),
        shape(**_DAY),
    ),
    # Aggregations.
    "daily_prices": (
        lambda t: t.daily(),
        shape(**_DAY, **_LABELS, URL="=", timestamp="t"),
    ),
    "daily_means": (
        lambda t: daily_means(t.events),
        shape(product_id="l", date="d", price="r", n_obs="l", timestamp="t"),
    ),
    "catalogue": (
        lambda t: catalog.catalogue(t.folded),
        shape(**_KEY, **_LABELS, n_obs="l"),
    ),
    "distinct_keys": (lambda t: catalog.distinct_keys(t.folded), shape(**_KEY)),
    "latest_url": (lambda t: catalog.latest_url(t.folded), shape(**_KEY, URL="=")),
    "price_stats": (
        lambda t: catalog.price_stats(t.daily()),
        shape(
            **_KEY, last_price="r", avg_price="r", min_price="r", max_price="r", n_days="l"
        ),
    ),
    "date_bounds": (
        lambda t: catalog.date_bounds(t.daily()),
        shape(
            **_KEY, first_day="d", last_day="d", category_first_day="d", category_last_day="d"
        ),
    ),
    "price_quantiles": (
        lambda t: training.price_quantiles(t.daily()),
        shape(**_KEY, q_low="r", q_high="r"),
    ),
    "eligible_products": (
        lambda t: training.eligible_products(t.daily()),
        shape(**_KEY, n_obs="l"),
    ),
    "trim_outliers": (lambda t: training.trim_outliers(t.daily()), shape(**_DAY)),
    # Movers.
    "market_movers": (lambda t: movers.market_movers(t.folded), _MOVER),
    "top_drops": (lambda t: movers.top_drops(movers.market_movers(t.folded)), _MOVER),
    "top_rises": (lambda t: movers.top_rises(movers.market_movers(t.folded)), _MOVER),
    "top_changes": (lambda t: movers.top_changes(movers.market_movers(t.folded)), _MOVER),
    "mover_lists": (
        lambda t: movers.ranked_movers(movers.market_movers(t.folded)),
        shape(**_MOVER, side="=", place="i"),
    ),
    # New days without the history.
    "appended_features": (lambda t: t.appended(), shape(**_DAY, **TABLET_SHAPE)),
    "refit_appended": (lambda t: t.refitted(), _COEFFICIENTS),
    # From the series stored by month and shard.
    "stored_range": (
        lambda t: read_series(t.spark, t.series, HISTORY_FROM, HISTORY_TO),
        shape(**_DAY),
    ),
    "stored_selection": (
        # The three busiest products of the catalogue over the same days.
        lambda t: read_selected(
            t.spark, t.series, catalog.catalogue(t.folded).limit(3), HISTORY_FROM, HISTORY_TO
        ),
        shape(**_DAY),
    ),
    "memoised_daily": (lambda t: t.memoised(), shape(**_DAY, **_LABELS, URL="=", timestamp="t")),
    # From the store that new files are folded into.
    "stored_movers": (lambda t: movers.market_movers(t.refolded), _MOVER),
    "stored_catalogue": (
        lambda t: catalog.catalogue(t.refolded),
        shape(**_KEY, **_LABELS, n_obs="l"),
    ),
    "late_roll_up": (
        lambda t: t.late_days(),
        shape(product_id="l", date="d", price="r", n_obs="l", timestamp="t"),
    ),
    "mover_text": (
        lambda t: movers.mover_text(movers.market_movers(t.folded)),
        shape(product="=", website="=", change="=", current="="),
    ),
    # Windows and features.
    "rolling_features": (
        lambda t: _with_windows(t.daily(), features.rolling_columns()),
        shape(**_DAY, **_ROLLING),
    ),
    "lag_features": (
        lambda t: _with_windows(t.daily(), features.lag_columns()),
        shape(**_DAY, **_LAGS),
    ),
    "pct_change_features": (
        lambda t: _with_windows(t.daily(), features.pct_change_columns()),
        shape(**_DAY, **_CHANGES),
    ),
    "calendar_features": (
        lambda t: _with_windows(
            t.daily(), {"day_index": features.day_index()}, calendar_fields(F.col("date"))
        ),
        shape(**_DAY, day_index="i", **_CALENDAR),
    ),
    "spec_features": (
        lambda t: _with_windows(t.daily(), spec_fields(F.col("ram_gb"), F.col("storage_gb"))),
        shape(**_DAY, **_SPECS),
    ),
    "tablet_features": (
        lambda t: training.tablet_features(t.daily("tablet")),
        shape(**_DAY, **TABLET_SHAPE),
    ),
    "mobile_features": (
        lambda t: training.mobile_features(t.stored("mobile")),
        shape(**_DAY, **MOBILE_SHAPE),
    ),
    "latest_features": (
        lambda t: forecast.latest_features(t.stored("mobile")),
        shape(**_DAY, **MOBILE_SHAPE),
    ),
    # Splits and training sets.
    "next_price_target": (
        lambda t: training.next_price_target(t.daily()),
        shape(**_DAY, target="r"),
    ),
    "per_product_split": (
        lambda t: training.per_product_split(t.daily()),
        shape(**_DAY, is_train="="),
    ),
    "global_split": (
        lambda t: training.global_split(t.stored()),
        shape(**_DAY, is_train="="),
    ),
    "tablet_training_set": (
        lambda t: training.tablet_training_set(t.daily("tablet"), t.folder("tablet-rows")),
        shape(**_DAY, **TABLET_SHAPE, target="r", is_train="="),
    ),
    "mobile_training_set": (
        lambda t: training.mobile_training_set(t.stored("mobile")),
        shape(**_DAY, **MOBILE_SHAPE, target="r", is_train="="),
    ),
    "training_report": (
        _training_reports,
        shape(
            category="=", n_daily_rows="l", n_products="l", n_eligible="l", n_skipped="l", n_train_rows="l",
            n_test_rows="l",
        ),
    ),
    # Fit, scores, metrics.
    "ols_moments": (
        lambda t: model.moments_table(
            training.tablet_training_rows(t.daily("tablet")),
            [*features.TABLET_FEATURES, "target"],
        ),
        shape(x="=", y="=", n="l", mean_product="f"),
    ),
    "fit_tablet": (lambda t: _coefficients(t, "tablet"), _COEFFICIENTS),
    "fit_mobile": (lambda t: _coefficients(t, "mobile"), _COEFFICIENTS),
    "model_roundtrip": (_model_roundtrip, _COEFFICIENTS),
    "score_in_sample": (
        _score_in_sample,
        shape(**_DAY, target="r", is_train="=", prediction="r"),
    ),
    "fit_metrics": (
        lambda t: _of_both(t, lambda trained: trained.metrics),
        shape(category="=", is_train="=", **_METRICS),
    ),
    "fit_gap": (
        lambda t: _of_both(t, lambda trained: trained.gap),
        shape(category="=", train_mae="r", test_mae="r", gap_ratio="r", gap="="),
    ),
    "regression_metrics": (
        lambda t: metrics.regression_metrics(t.lag_scored, ["category", "is_train"], "price"),
        shape(category="=", is_train="=", **_METRICS),
    ),
    "product_metrics": (
        lambda t: metrics.regression_metrics(t.lag_scored, [*training.KEY], "price"),
        shape(**_KEY, **_METRICS),
    ),
    "mae_gap": (
        lambda t: metrics.mae_gap(t.lag_scored, "price"),
        shape(train_mae="r", test_mae="r", gap_ratio="r", gap="="),
    ),
    # Forecasts.
    "recursive_forecast": (lambda t: _forecast_days(_recursive(t)), _FORECAST_DAY),
    "recursive_forecast_fixed": (
        lambda t: _forecast_days(forecast.recursive_forecast(t.daily(), FIXED_MODEL)),
        _FORECAST_DAY,
    ),
    "mobile_forecast": (lambda t: _forecast_days(_recursive(t, "mobile")), _FORECAST_DAY),
    "mobile_forecast_fixed": (
        lambda t: _forecast_days(
            forecast.recursive_forecast(t.stored("mobile"), FIXED_MOBILE_MODEL)
        ),
        _FORECAST_DAY,
    ),
    "next_price": (
        lambda t: forecast.next_price(t.stored("mobile"), t.model("mobile")),
        shape(**_DAY, next_price="r"),
    ),
    "forecast_calendar": (
        lambda t: forecast.forecast_calendar(t.baseline),
        shape(**_KEY, step="i", date="d", **_CALENDAR, iso_text="=", long_text="="),
    ),
    "forecast_bands": (lambda t: forecast.forecast_bands(t.baseline), _BANDS),
    "forecast_breakdown": (
        lambda t: forecast.forecast_breakdown(forecast.forecast_bands(t.baseline)),
        shape(**_KEY, step="i", date="=", price="=", lower="=", upper="="),
    ),
    "forecast_export": (
        _forecast_export,
        {
            **_KEY,
            "Date": "=",
            "Forecasted Price (EGP)": "r",
            "Lower Bound (EGP)": "r",
            "Upper Bound (EGP)": "r",
        },
    ),
    "chart_series": (
        lambda t: forecast.chart_series(
            _with_windows(t.daily(), features.rolling_columns()), t.baseline
        ),
        _POINTS,
    ),
    "compare_series": (
        lambda t: forecast.compare_series(
            forecast.chart_series(
                _with_windows(t.daily(), features.rolling_columns()), t.baseline
            )
        ),
        _POINTS,
    ),
    # Decisions.
    "confidence_tier": (
        lambda t: t.baseline.withColumn("confidence", signals.confidence_tier(F.col("n_days"))),
        shape(**_KEY, n_days="l", confidence="="),
    ),
    "trend_signal": (
        lambda t: signals.with_trend_text(signals.with_trend(t.baseline)),
        shape(**_KEY, trend_pct="r", trend="=", trend_text="=", trend_desc="="),
    ),
    "buy_signal": (
        lambda t: signals.with_signal_text(signals.with_buy_signal(t.baseline)),
        shape(
            **_KEY, change_pct="r", volatility_pct="r", signal="=", signal_icon="=",
            signal_title="=", signal_desc="=", signal_detail="=",
        ),
    ),
    "product_summary": (
        lambda t: t.summary,
        shape(
            **_KEY, **_LABELS, last_price="r", forecast_price="r", mae="r", n_days="l",
            change="r", change_pct="r", signal="=", confidence="=",
        ),
    ),
    "compare_products": (
        lambda t: signals.compare_products(t.summary),
        shape(
            **_KEY, product="=", last_price="r", forecast_price="r", change_pct="r",
            confidence="=", current_text="=", forecast_text="=", change_text="=", amount_text="=",
        ),
    ),
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    result, kinds = REGISTRY[name]
    configure(spark, *sample_tables.paths(sf_dir))
    return shape_frame(result(Tables(spark, sf_dir)), kinds)
