"""Table writers. Every table is a folder of part files written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def globally_sorted(df: DataFrame, order_by: str) -> DataFrame:
    """Sort by one column without letting a repeated value fill a single task.

    A range shuffle cannot split rows that compare equal, so the partition a row
    came from breaks ties; it is stable across task retries, unlike a random tie.
    """
    tie = "_came_from"
    return df.withColumn(tie, F.spark_partition_id()).orderBy(order_by, tie).drop(tie)


def write_table(df: DataFrame, path: str, order_by: str | None = None, fmt: str = "parquet") -> str:
    """Replace the table at ``path``; sort first if the sort column is there."""
    if order_by and order_by in df.columns:
        df = globally_sorted(df, order_by)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table, wherever Spark can write one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
