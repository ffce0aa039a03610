"""Display text. ``format_number`` rounds half-even on the exact binary value.

Amounts have thousands separators, percentages have none. A sign is that of the
number, so a negative zero and what rounds to zero from below show a minus.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the currency of every amount.
CURRENCY = "EGP"


def _signed(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("-")), text).otherwise(F.concat(F.lit("+"), text))


def egp(amount: Column) -> Column:
    """``EGP 1,234``"""
    return F.concat(F.lit(f"{CURRENCY} "), F.format_number(amount, 0))


def signed_egp(amount: Column) -> Column:
    """``+1,234 EGP``"""
    return F.concat(_signed(F.format_number(amount, 0)), F.lit(f" {CURRENCY}"))


def percent(value: Column) -> Column:
    """``1234.5%``"""
    return F.concat(F.call_function("format_number", value, F.lit("0.0")), F.lit("%"))


def signed_percent(value: Column) -> Column:
    """``+1234.5%``"""
    return _signed(percent(value))


def title_case(text: Column) -> Column:
    """Capital after every non-letter, so ``o-neil`` gives ``O-Neil``."""
    # Cut behind each non-letter: every piece then starts one word.
    pieces = F.split(text, r"(?<=[^\p{L}])")
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2)))),
        ),
        "",
    )


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def long_date(date: Column) -> Column:
    """``Friday, January 05``"""
    return F.date_format(date, "EEEE, MMMM dd")
