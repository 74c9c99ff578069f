"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.staging import stage

#: White space between words, as in every contract of this subpackage.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, cast; whatever else ``df`` carries cannot clash with an operator's own names."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


def content_hash(text: Column) -> Column:
    """64 bits of a text; null counts as the empty text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def split_words(text: Column) -> Column:
    """Words of a text; a null or blank text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return F.filter(parts, lambda word: word != "")


def shingles(words: str, size: int) -> Column:
    """Windows of ``size`` words joined by one space; a shorter, nonempty text is one shingle by itself.

    ``words`` names a column that the frame already has. An expression would be worked out
    again for every window, as it would stand inside the function over windows.
    """
    return _windows(words, size, lambda window: F.array_join(window, " "), "string")


def shingle_hashes(words: str, size: int) -> Column:
    """``xxhash64`` of each of the same windows."""
    return _windows(words, size, F.xxhash64, "bigint")


def _windows(words: str, size: int, made: Callable[[Column], Column], kind: str) -> Column:
    count = F.size(F.col(words))
    starts = F.sequence(F.lit(1), F.greatest(count - (size - 1), F.lit(1)))
    windows = F.transform(starts, lambda i: made(F.slice(F.col(words), i, size)))
    return F.when(count == 0, F.array().cast(f"array<{kind}>")).otherwise(windows)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a worker holds Python objects of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sampled(df: DataFrame, key: str, cell: Column, count: int) -> list[str]:
    """``cell`` of the rows that have the ``count`` least hashes of ``key``, in their order, on the driver.

    Keys are picked first and by themselves, so no task sends cells of rows that are not in the sample. Of
    rows that repeat a key, a null one too, one cell counts. The caller bounds the length of a cell.
    """
    ranked = df.select(F.xxhash64(key).alias("__rank"), F.col(key).alias("__key")).orderBy("__rank", "__key")
    picked = stage(ranked.limit(count).distinct(), "sample-keys")
    found = df.join(picked.select("__key"), F.col(key).eqNullSafe(F.col("__key")), "left_semi").select(key, cell.alias("__cell"))
    found = found.groupBy(key).agg(F.min(F.struct(F.xxhash64("__cell").alias("__hash"), "__cell")).alias("__one"))
    rows = found.select(F.xxhash64(key).alias("rank"), F.col(key).alias("key"), F.col("__one.__cell").alias("cell")).collect()
    return [row["cell"] for row in sorted(rows, key=lambda row: (row["rank"], row["key"] is not None, row["key"] or 0))]
