"""Eligibility, outlier bands, splits and the two training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewake.operators.features import (
    MOBILE,
    TABLET,
    add_features,
    global_anchor,
    series_window,
    whole_series,
)
from pricewake.schema import KEY
from pricewake.sources.stored import store

# Fixed values of the training recipe.
MIN_OBS = 10
TEST_SIZE = 0.2
LOW_QUANTILE, HIGH_QUANTILE = 0.01, 0.99
MIN_MOVER_OBS = 2

# Position of a daily row within its product, from 1.
ROW = "row_in_product"

# Ranges the product keys are cut into to find a row position without one global sort.
_FENCES = 255
# Keys that are accumulated in one task once a range holds no more.
_FEW_KEYS = 10_000


def eligible_products(daily: DataFrame, min_obs: int = MIN_OBS) -> DataFrame:
    """Products with at least ``min_obs`` daily rows."""
    return daily.groupBy(*KEY).agg(F.count("*").alias("n_obs")).where(F.col("n_obs") >= min_obs)


def _interpolated(q: float, rank: Column, n: Column, counted: Column, all_rows) -> Column:
    """Linear quantile from the ranked prices, anchored at the nearer neighbour.

    Computed prices of one product often differ in the last bit only. Weighing
    two such neighbours can land outside both and drop a row that lies on the
    bound, so the interpolation starts from one of them.
    """
    position = (n - 1) * F.lit(q)
    low = F.floor(position)
    share = position - low

    def at(place: Column) -> Column:
        return F.max(F.when(counted & (rank == place), F.col("price"))).over(all_rows)

    below, above = at(low), at(F.least(low + 1, n - 1))
    step = above - below
    return F.when(share < 0.5, below + step * share).otherwise(above - step * (1 - share))


def _with_inside(rows: DataFrame, low: float, high: float, counted: Column) -> DataFrame:
    """Adds ``inside``: price within the quantile band of the product's ``counted`` rows.

    Ranked by a sort within the product's partition; rows are bounded by the
    days tracked and nothing is shuffled again.
    """
    by_price = Window.partitionBy(*KEY).orderBy(F.desc("is_counted"), F.asc_nulls_last("price"))
    all_rows = by_price.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        rows.withColumn("is_counted", counted & F.col("price").isNotNull())
        .withColumn("price_rank", F.row_number().over(by_price) - 1)
        .withColumn("n_counted", F.count_if("is_counted").over(all_rows))
    )
    rank, n, is_counted = F.col("price_rank"), F.col("n_counted"), F.col("is_counted")
    banded = ranked.select(
        "*",
        _interpolated(low, rank, n, is_counted, all_rows).alias("q_low"),
        _interpolated(high, rank, n, is_counted, all_rows).alias("q_high"),
    )
    # Without counted rows there is no band and nothing lies inside.
    inside = F.coalesce(F.col("price").between(F.col("q_low"), F.col("q_high")), F.lit(False))
    return banded.withColumn("inside", inside).drop("is_counted", "price_rank", "n_counted")


def trim_outliers(
    daily: DataFrame, low: float = LOW_QUANTILE, high: float = HIGH_QUANTILE
) -> DataFrame:
    """Rows inside their own product's quantile band, bounds included."""
    return _with_inside(daily, low, high, F.lit(True)).where("inside").drop(
        "inside", "q_low", "q_high"
    )


def price_quantiles(
    daily: DataFrame, low: float = LOW_QUANTILE, high: float = HIGH_QUANTILE
) -> DataFrame:
    """The band of ``trim_outliers`` per product: its own interpolated quantiles."""
    banded = _with_inside(daily, low, high, F.lit(True))
    return banded.groupBy(*KEY).agg(F.max("q_low").alias("q_low"), F.max("q_high").alias("q_high"))


def train_rows(n: Column, test_size: float = TEST_SIZE) -> Column:
    """Rows of ``n`` that go to the training part."""
    return F.floor(n * F.lit(1.0 - test_size))


def per_product_split(daily: DataFrame, test_size: float = TEST_SIZE) -> DataFrame:
    """Chronological split of each product: ``is_train`` on its first rows."""
    n = F.count("*").over(whole_series())
    row = F.row_number().over(series_window())
    return daily.withColumn("is_train", row <= train_rows(n, test_size))


def _in_ranges(counts: DataFrame) -> DataFrame | None:
    """Adds ``range``, its keys being cut at an even sample of themselves; None without any."""
    # The keys of least hash: a sample that depends on the data alone.
    sample = counts.orderBy(F.xxhash64(*KEY), *KEY).limit(_FENCES).select(*KEY).collect()
    if not sample:
        return None
    parts = ", ".join(f"{name}: string" for name in KEY)
    fences = counts.sparkSession.createDataFrame(
        [(sorted(map(tuple, sample)),)], f"fences array<struct<{parts}>>"
    ).scalar()
    key = F.struct(*KEY)
    return (
        counts.withColumn("fences", fences)
        .withColumn("range", F.size(F.filter("fences", lambda f: f <= key)))
        .drop("fences")
    )


def _cut_point(
    counts: DataFrame, test_size: float, few: int = _FEW_KEYS
) -> tuple[str, str, int] | None:
    """The product the global split runs through, and its rows before the cut.

    ``counts`` holds one row per product. Its keys are cut into ranges, of which
    the driver sees one total each; the range the cut falls in is cut again until
    it holds ``few`` keys, which are then accumulated one by one.
    """
    left, before, cut = counts, 0, None
    while True:
        ranged = _in_ranges(left)
        if ranged is None:
            return None
        totals = sorted(
            ranged.groupBy("range").agg(F.sum("n_rows"), F.count("*")).collect()
        )
        if cut is None:
            cut = int(sum(n for _, n, _ in totals) * (1.0 - test_size))
        for hit, n, n_keys in totals:
            if before + n > cut:
                break
            before += n
        left = ranged.where(F.col("range") == hit).drop("range")
        if n_keys <= few:
            break
    through = F.sum("n_rows").over(
        Window.partitionBy(F.lit(0)).orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
    )
    first = (
        left.withColumn("through", F.lit(before) + through)
        .where(F.col("through") > cut)
        .orderBy("through")
        .select(*KEY, (F.lit(cut) - F.col("through") + F.col("n_rows")).alias("head"))
        .first()
    )
    return tuple(first)


def global_split(series: DataFrame, test_size: float = TEST_SIZE) -> DataFrame:
    """Positional split of the whole frame in (product, date) order.

    Products before the one the cut falls in train, later ones test; that one
    product is split by row number, taken from ``ROW`` where present. Finding
    it reads ``series`` once, right away; persist an expensive one beforehand.
    """
    counts = series.groupBy(*KEY).agg(F.count("*").alias("n_rows")).persist()
    try:
        cut = _cut_point(counts, test_size)
    finally:
        counts.unpersist()
    if cut is None:
        return series.withColumn("is_train", F.lit(False))
    *cut_key, head = cut
    key = F.struct(*KEY)
    cut_at = F.struct(*[F.lit(part).alias(name) for name, part in zip(KEY, cut_key, strict=True)])
    if ROW not in series.columns:
        series = series.withColumn(ROW, F.row_number().over(series_window()))
    return series.withColumn(
        "is_train", (key < cut_at) | ((key == cut_at) & (F.col(ROW) <= head))
    ).drop(ROW)


def next_price_target(daily: DataFrame) -> DataFrame:
    """Next row's price as ``target``; a product's last row has none and goes."""
    target = F.lead("price", 1).over(series_window())
    return daily.withColumn("target", target).where(F.col("target").isNotNull())


def tablet_features(daily: DataFrame) -> DataFrame:
    return add_features(daily, TABLET)


def mobile_features(daily: DataFrame, anchor: Column | None = None) -> DataFrame:
    return add_features(daily, MOBILE, anchor)


def tablet_training_rows(daily: DataFrame, min_obs: int = MIN_OBS) -> DataFrame:
    """Trimmed series of the products that keep ``min_obs`` rows, with features.

    Only what training reads is kept, so that a persisted result does not hold
    back column pruning in the daily roll-up.

    Features are computed on the trimmed series and the target is the same
    day's price, which the rolling means contain; the recipe is reproduced.
    """
    product = Window.partitionBy(*KEY)
    trimmed = trim_outliers(daily).withColumn("n_kept", F.count("*").over(product))
    kept = trimmed.where(F.col("n_kept") >= min_obs)
    numbered = add_features(kept, TABLET).withColumn(ROW, F.row_number().over(series_window()))
    return numbered.select(
        *KEY, "date", "price", ROW, *TABLET.features, F.col("price").alias("target")
    )


def tablet_training_set(
    daily: DataFrame, folder: str, min_obs: int = MIN_OBS, test_size: float = TEST_SIZE
) -> DataFrame:
    """Training rows with their split.

    Finding the cut and the split itself both read the rows, so they are
    computed once and stored in ``folder``, on shared storage; the result reads
    them from there.
    """
    return global_split(store(tablet_training_rows(daily, min_obs), folder), test_size)


def mobile_gate(
    daily: DataFrame, min_obs: int = MIN_OBS, test_size: float = TEST_SIZE
) -> DataFrame:
    """Daily rows with the product's ``gate_open`` flag.

    The quantile band of the training part decides eligibility only; the rows
    themselves stay untrimmed.
    """
    n = F.count("*").over(whole_series())
    row = F.row_number().over(series_window())
    split = daily.withColumn("in_head", row <= train_rows(n, test_size)).withColumn(
        "n_days", n
    )
    banded = _with_inside(split, LOW_QUANTILE, HIGH_QUANTILE, F.col("in_head"))
    product = Window.partitionBy(*KEY)
    head_kept = F.count_if(F.col("inside") & F.col("in_head")).over(product)
    tail_kept = F.count_if(F.col("inside") & ~F.col("in_head")).over(product)
    rows_with_target = F.col("n_days") - 1
    gate = (
        (head_kept >= min_obs)
        & (tail_kept >= 1)
        & (rows_with_target >= min_obs)
        & (train_rows(rows_with_target, test_size) >= 1)
        & (train_rows(rows_with_target, test_size) < rows_with_target)
    )
    return banded.withColumn("gate_open", gate).drop("in_head", "inside", "q_low", "q_high")


def mobile_training_set(
    daily: DataFrame,
    min_obs: int = MIN_OBS,
    test_size: float = TEST_SIZE,
    anchor: Column | None = None,
) -> DataFrame:
    """Eligible products' untrimmed series with features, next-price target and split.

    Features come from the full series: a look-back of 7 rows is all they use,
    so a test row sees the same context as with training rows prepended.
    """
    # The anchor is the first day of all products, eligible or not.
    anchor = global_anchor(daily) if anchor is None else anchor
    featured = add_features(
        mobile_gate(daily, min_obs, test_size).where("gate_open"), MOBILE, anchor
    )
    numbered = featured.withColumn(ROW, F.row_number().over(series_window()))
    cut = train_rows(F.col("n_days") - 1, test_size)
    return next_price_target(numbered).select(
        *KEY, "date", "price", *MOBILE.features, "target", (F.col(ROW) <= cut).alias("is_train")
    )


def training_report(daily: DataFrame, min_obs: int = MIN_OBS) -> DataFrame:
    """One row of counts for the mobile recipe: loaded, eligible, skipped, train, test."""
    # One row per product: its daily rows and whether it passes the gate.
    per_product = mobile_gate(daily, min_obs).groupBy(*KEY).agg(
        F.count("*").alias("n_days"), F.bool_and("gate_open").alias("gate_open")
    )
    rows = F.when(F.col("gate_open"), F.col("n_days") - 1).otherwise(0)
    head = train_rows(rows)
    return per_product.agg(
        F.sum("n_days").alias("n_daily_rows"),
        F.count("*").alias("n_products"),
        F.count_if("gate_open").alias("n_eligible"),
        F.count_if(~F.col("gate_open")).alias("n_skipped"),
        F.sum(head).alias("n_train_rows"),
        F.sum(rows - head).alias("n_test_rows"),
    )


def tablet_report(
    daily: DataFrame, min_obs: int = MIN_OBS, test_size: float = TEST_SIZE
) -> DataFrame:
    """The same counts for the tablet recipe: eligible by trimmed rows, one cut through all of them."""
    trimmed = _with_inside(daily, LOW_QUANTILE, HIGH_QUANTILE, F.lit(True))
    per_product = trimmed.groupBy(*KEY).agg(
        F.count("*").alias("n_days"), F.count_if("inside").alias("n_kept")
    )
    eligible = F.col("n_kept") >= min_obs
    rows = F.coalesce(F.sum(F.when(eligible, F.col("n_kept"))), F.lit(0))
    return per_product.agg(
        F.sum("n_days").alias("n_daily_rows"),
        F.count("*").alias("n_products"),
        F.count_if(eligible).alias("n_eligible"),
        F.count_if(~eligible).alias("n_skipped"),
        train_rows(rows, test_size).alias("n_train_rows"),
        (rows - train_rows(rows, test_size)).alias("n_test_rows"),
    )
