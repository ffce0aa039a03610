"""Filter, clean and join listings and price observations."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewake.functions import cleaning
from pricewake.schema import ATTRIBUTES, CATEGORIES, resolve_category


def active_products(products: DataFrame, category: str | None = None) -> DataFrame:
    """Listings flagged active, of one category or of all known ones.

    ``category`` may be a free label such as "Tablets"; one that names no known
    category raises, as every loader that takes a label comes through here.
    """
    wanted = list(CATEGORIES) if category is None else [resolve_category(category)]
    return products.where(F.col("category").isin(wanted) & F.col("is_active"))


def tracked_products(products: DataFrame, category: str | None = None) -> DataFrame:
    """Active listings with typed specs and their product key, one row per listing."""
    types = {f.name: f.dataType for f in products.schema.fields}
    ram = cleaning.whole_gb(F.col("ram_gb"), types["ram_gb"])
    storage = cleaning.whole_gb(F.col("storage_gb"), types["storage_gb"])
    typed = active_products(products, category).select(
        F.col("id").alias("product_id"),
        "category",
        "name",
        "brand",
        "website",
        ram.alias("ram_gb"),
        storage.alias("storage_gb"),
        F.col("url").alias("URL"),
    )
    key = cleaning.product_key(
        F.col("name"), F.col("website"), F.col("ram_gb"), F.col("storage_gb")
    )
    return typed.withColumn("product_key", key)


def clean_prices(
    prices: DataFrame,
    stored_date: bool = False,
    keep_missing_price: bool = False,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """Typed observations; rows without a usable time are dropped.

    ``stored_date`` takes the day from the ``date`` column instead of the
    timestamp. ``keep_missing_price`` keeps rows whose price is unusable. Columns
    named by ``also`` are passed on.
    """
    types = {f.name: f.dataType for f in prices.schema.fields}
    parsed = {
        "price": cleaning.number(F.col("price"), types["price"]),
        "timestamp": cleaning.instant(F.col("timestamp"), types["timestamp"]),
    }
    if stored_date:
        parsed["date"] = cleaning.day(F.col("date"), types["date"])
    columns = [column.alias(name) for name, column in parsed.items()]
    if any(isinstance(types[name], T.StringType) for name in parsed):
        # A generator of one row: filters below cannot be pushed into the
        # parsing, which would then run again for each of them. Typed columns
        # stay plain, so that their filters do reach the scan.
        columns = [F.inline(F.array(F.struct(*columns)))]
    typed = prices.select(F.col("id").alias("obs_id"), "product_id", *also, *columns)
    kept = F.col("timestamp").isNotNull()
    if stored_date:
        kept = kept & F.col("date").isNotNull()
    else:
        typed = typed.withColumn("date", F.to_date("timestamp"))
    if not keep_missing_price:
        kept = kept & F.col("price").isNotNull()
    return typed.where(kept)


def semi_join_prices(
    products: DataFrame, prices: DataFrame, category: str | None = None
) -> DataFrame:
    """Raw price rows of active listings."""
    ids = active_products(products, category).select(F.col("id").alias("product_id"))
    return prices.join(ids, "product_id", "left_semi")


def load_observations(
    products: DataFrame,
    prices: DataFrame,
    category: str | None = None,
    stored_date: bool = True,
    keep_missing_price: bool = True,
) -> DataFrame:
    """Observations with their listing's attributes and product key.

    The inner join also drops prices of other listings, so no separate semi
    join runs. No hint: Spark broadcasts the listings only below its size
    threshold and otherwise splits skewed listings at run time.
    """
    return clean_prices(prices, stored_date, keep_missing_price).join(
        tracked_products(products, category), "product_id"
    ).select(
        "category", "product_key", "obs_id", "price", "timestamp", "date", *ATTRIBUTES
    )


# Days that a stored date may be off its timestamp with the order still exact.
DAYS_OFF = 10
_DAY_MICROS = 86_400_000_000


def observed_at() -> Column:
    """Place of an observation in (date, timestamp, obs_id) order as one fixed-width number.

    From the high digits down: the day, how many days the timestamp is off it, the
    time of day, the id; a missing id comes first. Of observations whose timestamp
    is more than ``DAYS_OFF`` days off their stored date, only the time of day
    counts within that date. Fits 38 digits for any id and the years 1 to 9999.
    """
    micros = F.unix_micros("timestamp")
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long")
    own_day = F.floor(micros / _DAY_MICROS)
    off = F.greatest(F.least(own_day - day, F.lit(DAYS_OFF)), F.lit(-DAYS_OFF)) + DAYS_OFF
    time = (day * (2 * DAYS_OFF + 1) + off) * _DAY_MICROS + F.pmod(micros, F.lit(_DAY_MICROS))
    # More than there are ids, so that time always decides first.
    ids = F.lit(Decimal(2**64 + 1)).cast("decimal(20,0)")
    lowest = F.lit(Decimal(2**63 + 1)).cast("decimal(20,0)")
    number = F.coalesce(F.col("obs_id").cast("decimal(20,0)") + lowest, F.lit(Decimal(0)))
    return (time.cast("decimal(19,0)") * ids + number).cast("decimal(38,0)")


def fold_listings(observations: DataFrame) -> DataFrame:
    """Observations of ``clean_prices`` folded to one row per listing.

    Carries what the per-product reports need: row and price counts, the first
    and last price in the order of ``observed_at``, and where they lie. All
    buffers are fixed width, so both phases are hash aggregates: no raw row is
    sorted, and a busy listing leaves each map task as one row. Equal ids at one
    time leave it open which price is taken.
    """
    return _observed(fold_ends(observations))


def fold_ends(observations: DataFrame) -> DataFrame:
    """``fold_listings`` in plain columns, which merge with those of other observations."""
    placed = observations.select("product_id", "price", observed_at().alias("at"))
    return placed.groupBy("product_id").agg(
        F.count("*").alias("n_rows"),
        F.count("price").alias("n_prices"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.min_by("price", "at").alias("first_price"),
        F.max_by("price", "at").alias("last_price"),
    )


def merge_ends(ends: DataFrame) -> DataFrame:
    """Rows of ``fold_ends`` merged to one per listing, in any order; buffers stay fixed width."""
    return ends.groupBy("product_id").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_prices").alias("n_prices"),
        F.min_by("first_price", "first_at").alias("first_price"),
        F.max_by("last_price", "last_at").alias("last_price"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )


def _observed(ends: DataFrame) -> DataFrame:
    def observed(end: str) -> Column:
        return F.struct(
            F.col(f"{end}_at").alias("at"), F.col(f"{end}_price").alias("price")
        ).alias(f"{end}_obs")

    return ends.select("product_id", "n_rows", "n_prices", observed("first"), observed("last"))


def folded_from_ends(products: DataFrame, ends: DataFrame, category: str | None = None) -> DataFrame:
    """What ``fold_products`` gives, from partial rows folded batch by batch."""
    return _observed(merge_ends(ends)).join(tracked_products(products, category), "product_id")


def fold_products(
    products: DataFrame,
    prices: DataFrame,
    category: str | None = None,
    stored_date: bool = True,
) -> DataFrame:
    """Folded listings with their attributes; still one row per listing."""
    folded = fold_listings(clean_prices(prices, stored_date, keep_missing_price=True))
    return folded.join(tracked_products(products, category), "product_id")
