"""Recursive and one-step forecasts for all products at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewake.functions.calendar import calendar_fields
from pricewake.functions.text import egp, iso_date, long_date
from pricewake.operators.features import (
    MOBILE,
    PROFILES,
    TABLET,
    Profile,
    add_features,
    series_window,
    whole_series,
)
from pricewake.operators.metrics import metric_columns
from pricewake.operators.model import LinearModel
from pricewake.operators.signals import confidence_tier, with_trend
from pricewake.schema import KEY

# Forecast length, the rows any feature looks back, and the label of both models.
HORIZON_DAYS = 7
LOOKBACK = 7
MODEL_TYPE = "Global Linear Regression"

# Headings and file name of the CSV download.
EXPORT_HEADINGS = (
    "Date",
    "Forecasted Price (EGP)",
    "Lower Bound (EGP)",
    "Upper Bound (EGP)",
)
EXPORT_MARK, EXPORT_ENDING = "_forecast_", ".csv"


def score(featured: DataFrame, model: LinearModel) -> DataFrame:
    return featured.withColumn("prediction", model.predict())


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return total / F.size(values)


def _tablet_inputs(recent: Column, step: Column, state: Column) -> dict[str, Column]:
    """Model inputs of the day to predict, from the last prices before it, real or predicted.

    ``recent`` holds at most the last 7, oldest first, so its first element is
    the 7-row lag and also the first price of a younger product. The deviation
    is the population one and the changes are 0, unlike in training.
    """
    first, length = F.element_at(recent, 1), F.size(recent)
    last3 = F.slice(recent, F.greatest(length - 2, F.lit(1)), 3)
    mean3 = _mean(last3)
    return {
        "day_index": state["day_index"] + step,
        **calendar_fields(F.date_add(state["date"], step)),
        "rolling_avg_3": mean3,
        "rolling_avg_7": _mean(recent),
        "rolling_std_3": F.sqrt(_mean(F.transform(last3, lambda x: (x - mean3) * (x - mean3)))),
        "price_lag_1": F.element_at(recent, -1),
        "price_lag_3": F.when(length >= 3, F.element_at(recent, -3)).otherwise(first),
        "price_lag_7": first,
        "pct_change_1": F.lit(0.0),
        "pct_change_3": F.lit(0.0),
        **_spec_inputs(state),
    }


def _mobile_inputs(recent: Column, step: Column, state: Column) -> dict[str, Column]:
    """Training features of the row before the day to predict, whose price is the newest.

    ``recent`` holds at most the last 8 prices, oldest first: the row's own and
    the 7 it looks back on. At the first step this is the product's last real
    row, so the first prediction is that of ``next_price``.
    """
    length = F.size(recent)

    def newest(n: int) -> Column:
        return F.slice(recent, F.greatest(length - (n - 1), F.lit(1)), n)

    def back(k: int) -> Column:
        return F.when(length > k, F.element_at(recent, -1 - k)).otherwise(F.element_at(recent, 1))

    last3 = newest(3)
    mean3 = _mean(last3)
    squares = F.aggregate(last3, F.lit(0.0), lambda acc, x: acc + (x - mean3) * (x - mean3))
    return {
        "day_index": state["day_index"] + step - 1,
        **calendar_fields(F.date_add(state["date"], step - 1)),
        "rolling_avg_3": mean3,
        "rolling_avg_7": _mean(newest(7)),
        "rolling_std_3": F.when(length > 1, F.sqrt(squares / (F.size(last3) - 1))).otherwise(0.0),
        "price_lag_1": back(1),
        "price_lag_3": back(3),
        "price_lag_7": back(7),
        **_spec_inputs(state),
    }


def _spec_inputs(state: Column) -> dict[str, Column]:
    return {n: state[n] for n in ("ram_normalized", "storage_normalized", "specs_score")}


# Per profile: inputs of a future day and the number of prices they are taken from.
_SERVING = {
    TABLET.category: (_tablet_inputs, LOOKBACK),
    MOBILE.category: (_mobile_inputs, LOOKBACK + 1),
}


def _profile(model: LinearModel) -> Profile:
    """What the model was fitted on; a model of something else raises."""
    profile = PROFILES.get(model.category)
    if profile is None:
        raise ValueError(f"no profile for a model of category {model.category!r}")
    unknown = set(model.features) - set(profile.features)
    if unknown:
        raise ValueError(f"{model.category} has no features {sorted(unknown)}")
    return profile


def _own_rows(daily: DataFrame, model: LinearModel) -> tuple[DataFrame, Column | None]:
    """Daily rows of the model's category, and the day its index counts from."""
    rows = daily.where(F.col("category") == model.category)
    return rows, F.lit(model.anchor) if model.anchor else None


def _roll_forward(model: LinearModel, state: Column, days: int) -> Column:
    """Array of ``days`` predictions, each fed back as the newest price."""
    inputs, held = _SERVING[model.category]

    def advance(acc: Column, step: Column) -> Column:
        # Predict once, then append it to both arrays.
        prediction = model.predict(inputs(acc["recent"], step, state))
        return F.element_at(
            F.transform(
                F.array(prediction),
                lambda p: F.struct(
                    F.slice(
                        F.concat(acc["recent"], F.array(p)),
                        F.when(F.size(acc["recent"]) < held, F.lit(1)).otherwise(F.lit(2)),
                        held,
                    ).alias("recent"),
                    F.concat(acc["path"], F.array(p)).alias("path"),
                ),
            ),
            1,
        )

    start = F.struct(
        state["recent"].alias("recent"), F.array().cast("array<double>").alias("path")
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(days)), start, advance, lambda acc: acc["path"]
    )


def recursive_forecast(
    daily: DataFrame, model: LinearModel, days: int = HORIZON_DAYS
) -> DataFrame:
    """One row per product of the model's category: path, in-sample error, price statistics, trend.

    Features and anchor are those of the model's profile. The tablet model
    predicts a day from the prices before it. The mobile model predicts the next
    row's price; chaining it over several days is an extension of its one step.

    Rows are numbered in the sort the features need, and only the last prices of
    a product are gathered. The recursion stays in the JVM and holds 8 prices.
    """
    profile = _profile(model)
    rows, anchor = _own_rows(daily, model)
    _, held = _SERVING[model.category]
    from_end = F.count("*").over(whole_series()) - F.row_number().over(series_window())
    featured = score(add_features(rows, profile, anchor), model).withColumn("from_end", from_end)
    if profile is MOBILE:
        # What the prediction of a row is compared with.
        featured = featured.withColumn("actual", F.lead("price", 1).over(series_window()))
    else:
        featured = featured.withColumn("actual", F.col("price"))
    newest = F.collect_list(F.when(F.col("from_end") < held, F.struct("date", "price")))
    state = F.struct(
        "date", "price", "day_index", "ram_normalized", "storage_normalized", "specs_score"
    )
    errors = metric_columns(F.col("actual"), F.col("prediction"))
    per_product = featured.groupBy(*KEY).agg(
        F.max_by(state, "date").alias("last"),
        F.transform(F.array_sort(newest), lambda x: x["price"]).alias("recent"),
        errors["mae"].alias("mae"),
        errors["r2"].alias("r2"),
        F.avg("price").alias("avg_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.count("*").alias("n_days"),
    )
    last = F.col("state")
    rolled = per_product.withColumn("state", F.struct("last.*", "recent")).withColumn(
        "path", _roll_forward(model, last, days)
    )
    results = rolled.select(
        *KEY,
        last["date"].alias("last_date"),
        last["price"].alias("last_price"),
        F.element_at("path", -1).alias("forecast_price"),
        F.transform(
            "path",
            lambda p, i: F.struct(
                F.date_add(last["date"], i + 1).alias("date"), p.alias("price")
            ),
        ).alias("forecast"),
        "mae",
        "r2",
        "avg_price",
        "min_price",
        "max_price",
        "n_days",
        confidence_tier(F.col("n_days")).alias("confidence"),
        F.lit(MODEL_TYPE).alias("model_type"),
    )
    return with_trend(results)


def latest_features(
    daily: DataFrame, anchor: Column | None = None
) -> DataFrame:
    """Mobile features of each product's last row."""
    featured = add_features(daily, MOBILE, anchor)
    newest = F.lead("date", 1).over(series_window()).isNull()
    return featured.withColumn("newest", newest).where("newest").drop("newest")


def next_price(daily: DataFrame, model: LinearModel) -> DataFrame:
    """One-step prediction per product of the mobile category, with the model's anchor."""
    if _profile(model) is not MOBILE:
        raise ValueError(f"the {model.category} model does not predict the next row")
    rows, anchor = _own_rows(daily, model)
    return latest_features(rows, anchor).select(
        *KEY, "date", "price", model.predict().alias("next_price")
    )


def forecast_calendar(products: DataFrame, days: int = HORIZON_DAYS) -> DataFrame:
    """The future days of each product after ``last_date``, with calendar fields."""
    future = F.sequence(F.date_add("last_date", 1), F.date_add("last_date", days))
    dated = products.select(*KEY, F.posexplode(future).alias("position", "date"))
    return dated.select(
        *KEY,
        (F.col("position") + 1).alias("step"),
        "date",
        *[c.alias(n) for n, c in calendar_fields(F.col("date")).items()],
        iso_date(F.col("date")).alias("iso_text"),
        long_date(F.col("date")).alias("long_text"),
    )


def forecast_bands(forecasts: DataFrame) -> DataFrame:
    """One row per product and future day; the lower bound stops at 0."""
    days = forecasts.select(*KEY, "mae", F.posexplode("forecast").alias("position", "day"))
    price = F.col("day.price")
    return days.select(
        *KEY,
        (F.col("position") + 1).alias("step"),
        F.col("day.date").alias("date"),
        price.alias("price"),
        F.greatest(price - F.col("mae"), F.lit(0.0)).alias("lower"),
        (price + F.col("mae")).alias("upper"),
    )


def forecast_breakdown(bands: DataFrame) -> DataFrame:
    """Display form of the bands."""
    return bands.select(
        *KEY,
        "step",
        long_date(F.col("date")).alias("date"),
        egp(F.col("price")).alias("price"),
        egp(F.col("lower")).alias("lower"),
        egp(F.col("upper")).alias("upper"),
    )


def forecast_export(bands: DataFrame) -> DataFrame:
    """Columns of the CSV download, after the product they belong to."""
    columns = (iso_date(F.col("date")), F.col("price"), F.col("lower"), F.col("upper"))
    return bands.select(*KEY, *[c.alias(n) for c, n in zip(columns, EXPORT_HEADINGS, strict=True)])


def export_name(name: Column, day: Column) -> Column:
    """``<name>_forecast_<yyyymmdd>.csv``"""
    return F.concat(
        name, F.lit(EXPORT_MARK), F.date_format(day, "yyyyMMdd"), F.lit(EXPORT_ENDING)
    )


def write_forecast_csv(
    bands: DataFrame, path: str, product: tuple[str, str] | None = None
) -> None:
    """CSV of all products, split by category; of one product, just its four columns.

    ``product`` is the product key and category of the one wanted; its few rows
    are one file. For all products a directory each would mean as many tiny
    files, so there the product stays a column.
    """
    rows = forecast_export(bands)
    if product is None:
        writer = rows.write.partitionBy("category")
    else:
        for name, value in zip(KEY, product, strict=True):
            rows = rows.where(F.col(name) == value)
        writer = rows.drop(*KEY).coalesce(1).write
    writer.mode("overwrite").option("header", "true").csv(path)


def chart_series(featured: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Tidy points of the forecast chart: history, mean, bridge, forecast and band.

    ``featured`` is the history to show, already cut to its date range; each
    input is read once and fanned out row by row.
    """
    first_forecast = F.element_at("forecast", 1)

    def point(series: str, date: Column, value: Column) -> Column:
        return F.struct(
            F.lit(series).alias("series"), date.alias("date"), value.alias("value")
        )

    is_last = F.lead("date", 1).over(series_window()).isNull()
    day, price = F.col("date"), F.col("price")
    shown = [
        point("history", day, price),
        point("rolling_avg_7", day, F.col("rolling_avg_7")),
    ]
    history = featured.withColumn("is_last", is_last).select(
        *KEY,
        F.inline(
            F.when(F.col("is_last"), F.array(*shown, point("bridge", day, price))).otherwise(
                F.array(*shown)
            )
        ),
    )
    ahead = F.flatten(
        F.transform(
            "forecast",
            lambda d: F.array(
                point("forecast", d["date"], d["price"]),
                point("lower", d["date"], F.greatest(d["price"] - F.col("mae"), F.lit(0.0))),
                point("upper", d["date"], d["price"] + F.col("mae")),
            ),
        )
    )
    bridge = F.array(point("bridge", first_forecast["date"], first_forecast["price"]))
    future = forecasts.select(*KEY, F.inline(F.concat(bridge, ahead)))
    return history.unionByName(future)


def compare_series(series: DataFrame) -> DataFrame:
    """Points of the comparison chart: history and forecast lines only."""
    return series.where(F.col("series").isin("history", "forecast"))
