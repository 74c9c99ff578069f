"""CSV scans that keep what does not fit, with the reasons.

A typed scan turns a value that does not fit its type into null, which nobody can tell from a value
that was never there. Here every value is read as text once, and cast afterwards: a row with a value
that does not cast, or with too few or too many columns, is rejected with the column, the value and the
type that was wanted. Accepted and rejected rows come from one scan and one written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schemas import text_schema
from riskloom.sources.readers import scan_csv_with_record
from riskloom.sources.staging import stage

RECORD = "_record"


def _reason(column: str, value: Column, wanted: str) -> Column:
    return F.struct(F.lit(column).alias("column_name"), value.alias("value"), F.lit(wanted).alias("wanted"))


def _reasons(schema: T.StructType) -> Column:
    """Array of what is wrong with a row of texts, in the order of the columns; a broken line first."""
    checks = [F.when(F.col(RECORD).isNotNull(), _reason("", F.col(RECORD), f"{len(schema)} or more columns as in the header"))]
    for f in schema.fields:
        if not isinstance(f.dataType, T.StringType):
            value = F.col(f"`{f.name}`")
            checks.append(F.when(value.isNotNull() & value.try_cast(f.dataType).isNull(), _reason(f.name, value, f.dataType.simpleString())))
    return F.array_compact(F.array(*checks))


def check_csv(spark: SparkSession, path: str, schema: T.StructType, stage_name: str = "scan", **options: str) -> DataFrame:
    """The columns of ``schema`` as text, with ``reasons`` (empty for rows that fit) of each row."""
    rows = scan_csv_with_record(spark, path, text_schema(schema.names), RECORD, stage_name, **options)
    return rows.withColumn("reasons", _reasons(schema)).drop(RECORD)


def scan_csv_checked(
    spark: SparkSession, path: str, schema: T.StructType, stage_name: str = "scan", **options: str
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): typed rows, and rows as text with their ``reasons``. Every row is in one of them."""
    checked = stage(check_csv(spark, path, schema, stage_name, **options), "checked-scan")
    accepted = checked.filter(F.size("reasons") == 0)
    typed = accepted.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
    return typed, checked.filter(F.size("reasons") > 0)


def reject_counts(rejected: DataFrame) -> DataFrame:
    """Rejected values per column and wanted type."""
    reasons = rejected.select(F.inline("reasons"))
    return reasons.groupBy("column_name", "wanted").agg(F.count(F.lit(1)).alias("n_values"))
