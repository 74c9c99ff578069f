"""Column expressions that turn raw text into usable values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text patterns the cleaning rules are defined by.
CURRENCY_RUN = r"[\d\.]+"
SIGNED_CURRENCY = r"-?\d+(?:\.\d+)?"
ZIP5 = r"^(\d{5})"
PLAIN_NUMBER = r"^[0-9.]+$"
NULL_TEXT = "None"

DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def currency_amount(text: Column, strict: bool = False) -> Column:
    """First run of digits and dots as a number; nothing usable gives 0.

    So "$1,234.56" reads as 1 and "-5.0" as 5. ``strict`` drops thousands
    separators and keeps the sign instead. Pass text only: a large number printed
    in scientific notation would lose its exponent here.
    """
    source = F.regexp_replace(text, ",", "") if strict else text
    run = F.trim(F.regexp_extract(source, SIGNED_CURRENCY if strict else CURRENCY_RUN, 0))
    return F.coalesce(F.when(run != "", run.try_cast("double")), F.lit(0.0))


def zip5(text: Column) -> Column:
    """Leading five digits; other text gives an empty string, null stays null."""
    return F.regexp_extract(text, ZIP5, 1)


def guarded_number(text: Column) -> Column:
    """Unsigned plain decimals become numbers; null, "None" and all else become 0."""
    usable = text.isNotNull() & (text != NULL_TEXT) & text.rlike(PLAIN_NUMBER)
    return F.coalesce(F.when(usable, text.try_cast("double")), F.lit(0.0))


def null_to_zero(number: Column) -> Column:
    return F.coalesce(number, F.lit(0.0))


def coerced_number(value: Column) -> Column:
    """Any decimal notation becomes a number; null, NaN and other text become 0."""
    text = value.cast("string")
    number = F.when(text.rlike(DECIMAL_TEXT), text.try_cast("double"))
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def safe_key(text: Column) -> Column:
    """Identifier text as a bigint, or null."""
    return text.try_cast("bigint")
