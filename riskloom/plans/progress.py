"""Which stages of a written job are finished, and for which input.

Each stage leaves a record beside its tables: the key of what it was made from, and how many rows
each table got. A key is a digest of the stage's name, its parameters and the key before it; the
first one holds the fingerprints of the raw tables. A stage is finished if its record has the
key that is asked for and its tables still have the recorded rows, which Parquet footers tell.

The record goes before a stage's first table is replaced and comes back after its last one, so a
run that dies in between leaves none. Records are files of the table folder's own file system.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from riskloom.sources.readers import MissingInput, scan_parquet
from riskloom.sources.sinks import delete_path, write_table

RECORD = "stage string, key string, table_name string, n_rows bigint"


def stage_key(name: str, *made_from: object) -> str:
    return hashlib.sha256(json.dumps([name, *map(str, made_from)]).encode()).hexdigest()


def _record_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/progress/{name}"


def forget(spark: SparkSession, folder: str, name: str) -> None:
    """The stage counts as unfinished from now on."""
    delete_path(spark, _record_path(folder, name))


def _rows(spark: SparkSession, folder: str, table: str, name: str) -> int:
    return scan_parquet(spark, f"{folder.rstrip('/')}/{table}", stage=name).count()


def remember(spark: SparkSession, folder: str, name: str, key: str, tables: Sequence[str]) -> None:
    rows = [(name, key, table, _rows(spark, folder, table, name)) for table in tables]
    write_table(spark.createDataFrame(rows, RECORD).coalesce(1), _record_path(folder, name), fmt="json")


def recorded(spark: SparkSession, folder: str, name: str) -> list[tuple]:
    """(stage, key, table, rows) of a finished stage; empty if there is no record."""
    try:
        return [tuple(r) for r in spark.read.schema(RECORD).json(_record_path(folder, name)).collect()]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def is_finished(spark: SparkSession, folder: str, name: str, key: str, tables: Sequence[str]) -> bool:
    known = {table: rows for _, made_as, table, rows in recorded(spark, folder, name) if made_as == key}
    try:
        return set(known) == set(tables) and all(_rows(spark, folder, t, name) == n for t, n in known.items())
    except (MissingInput, AnalysisException):  # a table is gone, or has no files any more
        return False


def progress_table(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """The records of all finished stages."""
    return spark.createDataFrame([row for name in names for row in recorded(spark, folder, name)], RECORD)
