"""Selecting, renaming and completing columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.cleaning import coerced_number
from riskloom.schemas import PAYMENT_COLUMNS, PRESCRIBER_COLUMNS
from riskloom.sources.readers import require_columns


def select_renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    require_columns(df, names, "select")
    return df.select(*[F.col(raw).alias(new) for raw, new in names.items()])


def project_prescribers(raw: DataFrame) -> DataFrame:
    return select_renamed(raw, PRESCRIBER_COLUMNS)


def project_payments(raw: DataFrame) -> DataFrame:
    require_columns(raw, PAYMENT_COLUMNS, "payments")
    return raw.select(*PAYMENT_COLUMNS).withColumnsRenamed(PAYMENT_COLUMNS)


def select_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns that exist, in the order given."""
    return df.select(*[c for c in columns if c in df.columns])


def ensure_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every named column as a double; absent ones, nulls, NaN and text that is no decimal number are 0."""
    kinds = dict(df.dtypes)

    def feature(c: str) -> Column:
        if c not in kinds:
            return F.lit(0.0)
        if kinds[c] == "string":
            return coerced_number(F.col(c))
        return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))

    return df.withColumns({c: feature(c) for c in columns})


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Like ``ensure_features``, reading every column as text."""
    return df.withColumns({c: coerced_number(F.col(c)) if c in df.columns else F.lit(0.0) for c in columns})


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts, columns matched by name."""
    return reduce(lambda left, right: left.unionByName(right), parts)


def schema_listing(df: DataFrame) -> DataFrame:
    """One row per column: position, name and type."""
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("column_name"), F.lit(kind).alias("data_type"))
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))
