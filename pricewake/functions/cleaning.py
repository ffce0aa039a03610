"""Coercion of scraped text into typed columns. Bad input becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's notion of whitespace: Unicode White_Space plus the four separators.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# The JVM reads "12d" and "12f" as numbers; a scraped price like that is not one.
_JVM_SUFFIXES = ("d", "D", "f", "F")


def number(value: Column, dtype: T.DataType) -> Column:
    """DOUBLE, with unparsable text and NaN both NULL so that averages skip them."""
    parsed = value.try_cast("double")
    if isinstance(dtype, T.StringType):
        suffixed = F.substring(F.rtrim(value), -1, 1).isin(*_JVM_SUFFIXES)
        # "inf" ends on an f as well.
        parsed = F.when(~(suffixed & (F.abs(parsed) < float("inf"))), parsed)
    return F.nanvl(parsed, F.lit(None).cast("double"))


def whole_gb(value: Column, dtype: T.DataType) -> Column:
    """INT gigabytes: fractions truncate, missing or unusable values are 0."""
    return F.coalesce(number(value, dtype).try_cast("int"), F.lit(0))


def instant(value: Column, dtype: T.DataType) -> Column:
    """TIMESTAMP from ISO-8601 text (extended or basic form) or a timestamp column."""
    if not isinstance(dtype, T.StringType):
        return value.cast("timestamp")
    # The JVM would read "12:30" as a time of the current day; behind a year
    # there is no colon this early.
    dated = F.when(~F.instr(F.ltrim(value), ":").between(1, 4), value)
    return F.coalesce(
        F.try_to_timestamp(dated),
        F.try_to_timestamp(dated, F.lit("yyyyMMdd")),
        F.try_to_timestamp(dated, F.lit("yyyyMMdd'T'HHmmss")),
    )


def day(value: Column, dtype: T.DataType) -> Column:
    """DATE of an ISO-8601 text, timestamp or date column."""
    if isinstance(dtype, T.DateType):
        return value
    return F.to_date(instant(value, dtype))


def strip_edges(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_SPACE, "")


def product_key(name: Column, website: Column, ram_gb: Column, storage_gb: Column) -> Column:
    """Text identity of a product. Only the name is trimmed; a NULL part makes it NULL."""
    return F.concat(
        strip_edges(F.lower(name)),
        F.lit(" "),
        F.lower(website),
        F.lit(" "),
        ram_gb.cast("string"),
        F.lit(" "),
        storage_gb.cast("string"),
    )
