"""Column profiles that are stored per part of a table and merged without reading the table again.

A part is whatever the table grows by, such as a month. Its profile holds what merges exactly (counts,
mean, sum of squared deviations, extremes) and a HyperLogLog sketch of the values of each column,
which merges to the sketch of all parts. A new or corrected part replaces its own rows only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.profiling import numeric_columns

#: Logarithm of a sketch's registers; the standard error of an estimate is about 1.04 / sqrt(registers).
SKETCH_BITS = 12


def sketch_error(bits: int = SKETCH_BITS) -> float:
    return 1.04 / math.sqrt(2**bits)


def _hashed(field: T.StructField) -> Column:
    """64 bits per value; -0.0 counts as 0.0, and null stays null."""
    value = F.col(f"`{field.name}`")
    whole = value + F.lit(0.0) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else value
    return F.when(value.isNotNull(), F.xxhash64(whole))


def profile_parts(df: DataFrame, part: Column, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per part and column, from one pass over the table."""
    numeric = set(numeric_columns(df))
    nothing = F.lit(None).cast("double")

    def measured(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        number = c.cast("double")
        values = {"mean": F.avg(number), "squares": F.var_pop(number) * F.count(number), "min": F.min(number), "max": F.max(number)}
        return F.struct(
            F.lit(field.name).alias("column_name"), F.lit(field.dataType.simpleString()).alias("data_type"),
            F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isNull()).alias("n_missing"),
            *[(v if field.name in numeric else nothing).alias(n) for n, v in values.items()],
            F.hll_sketch_agg(_hashed(field), F.lit(bits)).alias("sketch"),
        )

    fields = df.schema.fields
    totals = df.groupBy(part.cast("string").alias("_part")).agg(*[measured(f).alias(f"_c{i}") for i, f in enumerate(fields)])
    rows = totals.select("_part", F.explode(F.array(*[F.col(f"_c{i}") for i in range(len(fields))])).alias("c"))
    return rows.select(F.coalesce("_part", F.lit("")).alias("part"), "c.*")


def store_profiles(profiles: DataFrame, path: str) -> str:
    """Write the parts that ``profiles`` has, in place of what the store has of them; other parts stay."""
    writer = profiles.write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return path


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("part", F.col("part").cast("string"))


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """The profile of all parts together, one row per column; rows per part and column are all that is read.

    Deviations are taken from the common mean first (a sum over one column's parts), so that large
    means lose no digits. ``n_distinct`` is the sketches' estimate, null counting as one value.
    """
    column = Window.partitionBy("column_name")
    known = F.col("n_rows") - F.col("n_missing")
    everywhere = F.sum(known * F.coalesce("mean", F.lit(0.0))).over(column) / F.nullif(F.sum(known).over(column), F.lit(0))
    away = F.col("mean") - F.col("everywhere")
    measured = profiles.withColumn("everywhere", everywhere)
    merged = measured.groupBy("column_name", "data_type").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"), F.sum(known).alias("known"),
        F.first(F.when(F.col("mean").isNotNull(), F.col("everywhere")), ignorenulls=True).alias("mean"),
        F.sum(F.col("squares") + known * away * away).alias("squares"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"),
    )
    spread = F.when(F.col("known") > 1, F.sqrt(F.col("squares") / (F.col("known") - 1)))
    return merged.select(
        "column_name", "data_type", "n_rows", "n_missing", "mean", spread.alias("stddev"), "min", "max",
        (F.col("estimate") + (F.col("n_missing") > 0).cast("bigint")).alias("n_distinct"),
    )
