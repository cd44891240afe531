"""Type conversions applied while a table moves from source to target."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_to_boolean(flag: Column) -> Column:
    """'Y'/'y' is true, 'N'/'n' is false, anything else is NULL."""
    letter = F.upper(flag)
    return F.when(letter.isin("Y", "N"), letter == "Y")


def decimal_to_float(amount: Column) -> Column:
    """Round to 32-bit precision, held as a double the way the target column stores it."""
    return amount.cast("float").cast("double")


def shift_timestamp(ts: Column, hours: int = 5) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(hours))


def empty_to_null(text: Column) -> Column:
    """NULL for text of spaces only; other text comes back untrimmed."""
    return F.when(F.length(F.trim(text)) > 0, text)


def is_soft_deleted(status: Column) -> Column:
    """True exactly for status 'DEL'; a NULL status counts as not deleted."""
    return status.eqNullSafe("DEL")


def canonical_text(value: Column) -> Column:
    return value.cast("string")


def percent_of(part: Column, base: Column) -> Column:
    """Share of ``base`` in percent with two decimals (half to even); 0.0 without a positive base."""
    share = part.cast("double") / F.when(base > 0, base.cast("double")) * 100
    return F.coalesce(F.bround(share, 2), F.lit(0.0))


def parse_iso_ts(text: Column) -> Column:
    """ISO-8601 text with an offset -> UTC TIMESTAMP_NTZ; NULL where it cannot be parsed."""
    local = text.try_cast("timestamp").cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
