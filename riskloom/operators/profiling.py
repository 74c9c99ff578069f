"""Data profiles: shape, nulls, distinct values, statistics, outliers and frequent values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.auditing import one_row_per_column
from riskloom.operators.projecting import schema_listing


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def dataset_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def missing_values(df: DataFrame) -> DataFrame:
    totals = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one_row_per_column(totals, "column_name", "n_missing")


def _statistics(column: str) -> list[tuple[str, Column]]:
    c = F.col(column).cast("double")
    return [
        ("n_values", F.count(c)),
        ("mean", F.avg(c)),
        ("stddev", F.stddev_samp(c)),
        ("min", F.min(c)),
        ("max", F.max(c)),
    ]


def _structs_to_rows(totals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column out of a one-row frame that holds a struct per column."""
    rows = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("s")) for c in columns])
    )
    return totals.select(rows.alias("r")).select("r.column_name", "r.s.*")


def summary_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample standard deviation, minimum and maximum of each numeric column."""
    names = list(columns or numeric_columns(df))
    totals = df.agg(*[F.struct(*[e.alias(n) for n, e in _statistics(c)]).alias(c) for c in names])
    return _structs_to_rows(totals, names)


def _cell(position: int, field: T.StructField) -> Column:
    """(position, text, number, whole number) of a cell: one of the three has the value, as it is; -0.0 counts as 0.0."""
    value = F.col(f"`{field.name}`")
    text, number, whole = (F.lit(None).cast(kind) for kind in ("string", "double", "bigint"))
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        number = value.cast("double") + F.lit(0.0)
    elif isinstance(field.dataType, T.IntegralType):
        whole = value.cast("bigint")
    else:
        text = value.cast("string")
    return F.struct(F.lit(position).alias("position"), text.alias("text"), number.alias("number"), whole.alias("whole"))


def _as_rows(df: DataFrame) -> DataFrame:
    """Every cell as a row; numbers are not printed for it."""
    return df.select(F.inline(F.array(*[_cell(i, f) for i, f in enumerate(df.schema.fields)])))


def distinct_counts(df: DataFrame) -> DataFrame:
    """Exact number of distinct values per column, null counting as one.

    All columns are counted in one pass: cells become (column, value) rows whose
    copies are merged before the shuffle, so a value that fills a third of a
    column costs one row per task.
    """
    values = _as_rows(df).distinct()
    counted = values.groupBy("position").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = schema_listing(df).select("position", "column_name")
    return names.join(counted, "position", "left").select(
        "column_name", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")
    )


def approximate_distinct_counts(df: DataFrame, error: float = 0.05) -> DataFrame:
    """Sketch-based counts for very wide or very varied tables; null is not counted."""
    totals = df.agg(*[F.approx_count_distinct(c, error).alias(c) for c in df.columns])
    return one_row_per_column(totals, "column_name", "n_distinct")


def profile_columns(df: DataFrame) -> DataFrame:
    """Type, nulls, distinct values and, for numbers, statistics of every column.

    Two passes over the table: one aggregate for all counts and statistics, one
    for the distinct values.
    """
    numeric = set(numeric_columns(df))
    nothing = F.lit(None).cast("double")
    totals = df.agg(
        *[
            F.struct(
                F.lit(kind).alias("data_type"),
                F.count_if(F.col(c).isNull()).alias("n_missing"),
                *[(e if c in numeric else nothing).alias(n) for n, e in _statistics(c) if n != "n_values"],
            ).alias(c)
            for c, kind in df.dtypes
        ]
    )
    return _structs_to_rows(totals, df.columns).join(distinct_counts(df), "column_name", "left")


def amount_stats(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("stddev"))


def outliers_3sigma(df: DataFrame, column: str) -> DataFrame:
    """Rows more than three sample standard deviations from the mean."""
    mean, spread = F.avg(column), 3 * F.stddev_samp(column)
    limits = df.agg(F.struct((mean - spread).alias("low"), (mean + spread).alias("high"))).scalar()
    return df.filter((F.col(column) > limits["high"]) | (F.col(column) < limits["low"]))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows; copies merge before the shuffle."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("n_duplicates"))


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Rows and edges of every equal-width bin, empty ones too; the maximum falls into the last bin.

    Where all values are equal, the first bin has them all and every edge is that value.
    """
    limits = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    values = df.filter(F.col(column).isNotNull()).select(
        F.col(column).cast("double").alias("value"), limits.alias("limits")
    )
    above, width = F.col("value") - F.col("limits.low"), F.col("limits.high") - F.col("limits.low")
    position = F.when(width > 0, F.floor(above / width * bins)).otherwise(0)
    binned = values.select(F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"))
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), limits.alias("limits"))
    step = (F.col("limits.high") - F.col("limits.low")) / bins
    edge = lambda k: F.col("limits.low").cast("double") + k * step
    return edges.join(counts, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


#: Columns of a block: the sums of a pair of blocks fit one generated aggregate.
CORRELATION_BLOCK = 3


def _correlation(a: str, b: str) -> Column:
    """Over the rows where both are known; null without spread on either side."""
    spread = [F.var_pop(F.when(F.col(other).isNotNull(), F.col(c))) for c, other in ((a, b), (b, a))]
    return F.when((spread[0] > 0) & (spread[1] > 0), F.covar_pop(a, b) / (F.sqrt(spread[0]) * F.sqrt(spread[1])))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, as (a, b, correlation) rows.

    A pair uses the rows where both are known. Columns are cut into blocks, a row becomes one row per
    pair of blocks where it is, and these are summed up per pair before the shuffle: one scan, as
    many groups as pairs of blocks, and aggregates whose number does not grow with the columns.
    A column without spread has no correlation.
    """
    names = list(columns or numeric_columns(df))
    size = CORRELATION_BLOCK
    blocks = [names[at : at + size] for at in range(0, len(names), size)]

    def values(block: Sequence[str], side: str) -> list[Column]:
        cells = [F.col(f"`{name}`").cast("double") for name in block] + [F.lit(None).cast("double")] * (size - len(block))
        return [c.alias(f"{side}{k}") for k, c in enumerate(cells)]

    pairs = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *values(blocks[i], "a"), *values(blocks[j], "b"))
        for i in range(len(blocks))
        for j in range(i, len(blocks))
    ]
    inner = [(k, l) for k in range(size) for l in range(size)]  # noqa: E741
    sums = df.select(F.inline(F.array(*pairs))).groupBy("i", "j").agg(
        F.array(*[_correlation(f"a{k}", f"b{l}") for k, l in inner]).alias("r")
    )
    labels = F.array(*[F.lit(name) for name in names])
    cells = sums.select("i", "j", F.posexplode("r").alias("cell", "r")).select(
        (F.col("i") * size + F.floor(F.col("cell") / size)).cast("int").alias("p"),
        (F.col("j") * size + F.col("cell") % size).cast("int").alias("q"),
        F.col("r").alias("correlation"),
        (F.col("i") < F.col("j")).alias("twice"),
    )
    # A pair of different blocks was summed up once and stands for both orders.
    orders = F.array(F.struct("p", "q"), F.when(F.col("twice"), F.struct(F.col("q").alias("p"), F.col("p").alias("q"))))
    both = cells.filter((F.col("p") < len(names)) & (F.col("q") < len(names))).select(
        "correlation", F.inline(F.array_compact(orders))
    )
    return both.select(F.get(labels, "p").alias("column_a"), F.get(labels, "q").alias("column_b"), "correlation")


def top_values(
    df: DataFrame, column: str, n: int = 10, keep_null: bool = True, weight: str | None = None
) -> DataFrame:
    """The ``n`` most frequent values; ties go to the smaller value.

    ``weight`` names a column of row counts, for a table that was already reduced
    to one row per key before a join.
    """
    source = df if keep_null else df.filter(F.col(column).isNotNull())
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counted = source.groupBy(F.col(column).alias("value")).agg(rows.alias("n_rows"))
    return counted.orderBy(F.desc("n_rows"), F.asc_nulls_last("value")).limit(n)


# The columns shown in the preview of scored prescribers.
PREVIEW_COLUMNS = [
    "prescriber_id",
    "provider_type",
    "state",
    "total_claims",
    "total_payment_amount",
    "payment_to_drug_cost_ratio",
    "opioid_claims",
    "peer_deviation_score",
    "fraud_risk_score",
    "fraud_risk_category",
]


def scored_preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy("prescriber_id").select(*PREVIEW_COLUMNS).limit(n)
