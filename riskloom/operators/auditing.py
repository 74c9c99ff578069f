"""Checks on raw and cleaned values, each one pass over the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.cleaning import DECIMAL_TEXT, safe_key
from riskloom.schemas import SCORING_RANGES

# The text patterns the audits are defined by.
SIGNED_DECIMAL = r"^-?\d+(\.\d+)?$"
DIGITS = r"^\d+$"
FIVE_DIGITS = r"^\d{5}$"
NUMBER_CHARACTERS = r"[0-9.+\-Ee]"

# The wording of refusals.
NOT_A_NUMBER = "enter a valid number."
OUT_OF_RANGE = "must be between"


def one_row_per_column(totals: DataFrame, label: str, value: str) -> DataFrame:
    """Turn a one-row frame of totals into (column name, total) rows."""
    return totals.unpivot([], totals.columns, label, value)


def audit_non_numeric(df: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Rows per column whose text does not match its pattern; null text is not counted."""
    totals = df.agg(*[F.count_if(~F.col(c).rlike(p)).alias(c) for c, p in patterns.items()])
    return one_row_per_column(totals, "column_name", "n_bad")


def non_numeric_rows(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """The rows behind one count of ``audit_non_numeric``."""
    return df.filter(~F.col(column).rlike(pattern))


def audit_post_clean(df: DataFrame, amount: str = "Payment_Amount", zip_code: str = "Zip") -> DataFrame:
    """Amounts that are still no number, and ZIP codes that are not five digits."""
    totals = df.agg(
        F.count_if(F.col(amount).try_cast("double").isNull()).alias(amount),
        F.count_if(~F.col(zip_code).rlike(FIVE_DIGITS)).alias(zip_code),
    )
    return one_row_per_column(totals, "column_name", "n_bad")


def audit_residual_chars(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per column with characters left over once those of a number are removed."""
    totals = df.agg(
        *[F.count_if(F.regexp_replace(F.col(c).cast("string"), NUMBER_CHARACTERS, "") != "").alias(c) for c in columns]
    )
    return one_row_per_column(totals, "column_name", "n_bad")


def bad_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows whose identifier is not a bigint, null included."""
    return df.filter(safe_key(F.col(key)).isNull())


# How a limit is printed: thousands separated, decimals only where there are some.
LIMIT_FORMAT = "#,##0.######"


def _printed(limit: float) -> Column:
    return F.call_function("format_number", F.lit(float(limit)), F.lit(LIMIT_FORMAT))


def _entered(column: str) -> Column:
    """The number that an input stands for: blank is 0, anything but decimal notation is null."""
    text = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.when(text == "", F.lit(0.0)).when(text.rlike(DECIMAL_TEXT), text.try_cast("double"))


def _range_error(column: str, low: float, high: float) -> Column:
    """Why one input is refused, or null."""
    number = _entered(column)
    outside = F.concat(F.lit(f"{column}: {OUT_OF_RANGE} "), _printed(low), F.lit(" and "), _printed(high), F.lit("."))
    return F.when(number.isNull(), F.lit(f"{column}: {NOT_A_NUMBER}")).when(~number.between(low, high), outside)


def validate_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = SCORING_RANGES) -> DataFrame:
    """Add ``errors`` (an array of messages in input order) and ``is_valid``."""
    checks = [_range_error(c, low, high) for c, (low, high) in ranges.items() if c in df.columns]
    checked = df.withColumn("errors", F.array_compact(F.array(*checks)))
    return checked.withColumn("is_valid", F.size("errors") == 0)


def parse_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = SCORING_RANGES) -> DataFrame:
    """The accepted rows with their inputs as doubles."""
    accepted = validate_ranges(df, ranges).filter("is_valid").drop("errors", "is_valid")
    return accepted.withColumns({c: _entered(c) for c in ranges if c in df.columns})
