"""Scans with declared schemas, and the checks that guard a stage's input."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schemas import text_schema


class MissingInput(FileNotFoundError):
    """A stage was started before its input table exists."""


class MissingColumns(ValueError):
    """An input table lacks columns the stage needs."""


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType, stage: str = "scan", **options: str
) -> DataFrame:
    """The columns of ``schema``, by name, from a CSV table that may hold many others.

    Only the header line is read to place the columns; types come from ``schema``,
    so there is no inference pass over the data, and the parser skips the columns
    that are not asked for. A value that does not fit its type reads as null.
    ``options`` are reader options, such as ``escape`` for files that double quotes.
    """
    return _scan(spark, path, schema, None, stage, options).select(*schema.names)


def scan_csv_with_record(
    spark: SparkSession, path: str, schema: T.StructType, record: str, stage: str = "scan", **options: str
) -> DataFrame:
    """The same, and in ``record`` the whole line where it has too few or too many columns, else null."""
    # Whether a line has as many columns as the header shows only if none are skipped.
    whole = _scan(spark, path, schema, record, stage, {"columnPruning": "false"} | options)
    return whole.select(*schema.names, record)


def _scan(spark, path: str, schema: T.StructType, record: str | None, stage: str, options: dict) -> DataFrame:
    reader = spark.read.option("header", True).option("enforceSchema", False).options(**options)
    header = _opened(lambda: reader.csv(path), path, stage).columns
    wanted = {f.name: f for f in schema.fields}
    absent = [name for name in wanted if name not in header]
    if absent:
        raise MissingColumns(f"{stage} requires columns: {', '.join(absent)}")
    fields = [wanted.get(name, T.StructField(name, T.StringType())) for name in header]
    if record:
        fields.append(T.StructField(record, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", record)
    return reader.schema(T.StructType(fields)).csv(path)


def scan_csv_text(
    spark: SparkSession, path: str, columns: Sequence[str], stage: str = "scan", **options: str
) -> DataFrame:
    """CSV scan that keeps every value as text."""
    return scan_csv(spark, path, text_schema(list(columns)), stage, **options)


def scan_parquet(
    spark: SparkSession, path: str, schema: T.StructType | None = None, stage: str = "scan"
) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return _opened(lambda: reader.parquet(path), path, stage)


def _opened(read, path: str, stage: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise MissingInput(f"{stage} requires input table: {path}") from error
        raise


def require_columns(df: DataFrame, columns: Iterable[str], stage: str = "stage") -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise MissingColumns(f"{stage} requires columns: {', '.join(absent)}")
    return df


def first_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in a stated order, so that a rerun reads the same rows."""
    return df.orderBy(*order_by).limit(n)


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the fields of ``schema``: present ones cast, absent ones null, others dropped."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )
