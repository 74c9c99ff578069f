"""Cleaning of the two raw tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.cleaning import currency_amount, guarded_number, null_to_zero, safe_key, zip5
from riskloom.operators.projecting import project_payments, project_prescribers
from riskloom.schemas import PRESCRIBER_NUMERIC


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def guard_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers out of text columns by the guarded reading; typed columns only lose their nulls."""
    return df.withColumns(
        {
            c: guarded_number(F.col(c)) if _is_text(df, c) else null_to_zero(F.col(c).cast("double"))
            for c in columns
            if c in df.columns
        }
    )


def fill_strings(df: DataFrame, value: str = "NA", skip: Sequence[str] = ()) -> DataFrame:
    text = [c for c in df.columns if _is_text(df, c) and c not in skip]
    return df.fillna(value, subset=text) if text else df


def null_to_zeros(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(columns))


def clean_amount(df: DataFrame, column: str = "Payment_Amount", strict: bool = False) -> DataFrame:
    """Text amounts are extracted; amounts that are already numbers pass unchanged but for nulls."""
    if _is_text(df, column):
        return df.withColumn(column, currency_amount(F.col(column), strict))
    return df.withColumn(column, null_to_zero(F.col(column).cast("double")))


def clean_zip(df: DataFrame, column: str = "Zip") -> DataFrame:
    return df.withColumn(column, zip5(F.col(column)))


def clean_payments(raw: DataFrame, strict: bool = False) -> DataFrame:
    return clean_zip(clean_amount(project_payments(raw), strict=strict))


def clean_prescribers(raw: DataFrame) -> DataFrame:
    """21 named columns: numbers without nulls, text without nulls, bigint identifier.

    Rows whose identifier is no number keep a null one, so that no row is lost
    here; joins on the identifier never match it.
    """
    named = project_prescribers(raw)
    numbers = guard_numeric(named, PRESCRIBER_NUMERIC)
    return fill_strings(numbers.withColumn("prescriber_id", safe_key(F.col("prescriber_id"))))


def valid_keys(df: DataFrame, text_key: str, number_key: str) -> DataFrame:
    """Add the key as a bigint and keep the rows where it is one."""
    return df.withColumn(number_key, safe_key(F.col(text_key))).filter(F.col(number_key).isNotNull())
