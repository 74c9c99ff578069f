"""Sampling, train/holdout splits and class balancing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.buckets import BUCKETS, murmur_bucket, sha_bucket

CLASSES = (0, 1, 2)
HASH_RANGE = 2**32

# Fixed value: the most copies a row of a rare class gets, unless another limit is asked for.
MAX_OVERSAMPLE = 10.0
# Keeps a sample's buckets apart from those of a split by the same key.
SAMPLE_SALT = "sample:"


def sample_uniform(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_hash(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Rows whose salted key hashes below the fraction: the same rows on every run, and any split of them is fair."""
    salted = F.concat(F.lit(SAMPLE_SALT), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return df.filter(sha_bucket(salted) < int(fraction * BUCKETS))


def mark_holdout(df: DataFrame, key: str = "prescriber_id", test_size: float = 0.2) -> DataFrame:
    """Add ``is_holdout``, decided by the SHA-256 bucket of the key."""
    return df.withColumn("is_holdout", sha_bucket(F.col(key)) / F.lit(float(BUCKETS)) >= F.lit(1.0 - test_size))


def mark_holdout_murmur(df: DataFrame, key: str = "prescriber_id", train_ratio: float = 0.8) -> DataFrame:
    """The same with Spark's own hash, folded so that the train share is ``train_ratio``."""
    return df.withColumn("is_holdout", murmur_bucket(F.col(key)) >= F.lit(int(train_ratio * BUCKETS)))


def split_marked(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, holdout) of a marked frame."""
    return df.filter(~F.col("is_holdout")).drop("is_holdout"), df.filter("is_holdout").drop("is_holdout")


def split_random(df: DataFrame, train_ratio: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """For tables without a key. Hand in a stored table, so that both sides see the same rows."""
    train, holdout = df.randomSplit([train_ratio, 1.0 - train_ratio], seed=seed)
    return train, holdout


def resample_plan(
    df: DataFrame, label: str, classes: Sequence[int] = CLASSES, most_copies: float = MAX_OVERSAMPLE
) -> DataFrame:
    """Sampling fraction per class that brings each to the mean class size, ``most_copies`` at most.

    At most one row per entry of ``classes``; a class without rows has no row. A row whose
    label is null or not listed stops the job, so that none is lost.
    """
    known = F.coalesce(F.col(label).isin(*classes), F.lit(False))
    totals = df.agg(
        *[F.count_if(F.col(label) == c).alias(f"n{c}") for c in classes], F.count_if(~known).alias("n_unlisted")
    )
    counts = F.array(*[F.struct(F.lit(c).alias(label), F.col(f"n{c}").alias("n_rows")) for c in classes])
    present = F.filter(counts, lambda s: s["n_rows"] > 0)
    total = F.aggregate(present, F.lit(0).cast("bigint"), lambda acc, s: acc + s["n_rows"])
    target = F.floor(total / F.size(present))
    message = F.concat(F.col("n_unlisted"), F.lit(f" rows have a {label} that is not one of {list(classes)}"))
    none_lost = F.when(F.col("n_unlisted") > 0, F.raise_error(message).cast("boolean")).otherwise(True)
    plan = totals.where(none_lost).select(F.explode(present).alias("c"), target.alias("target")).select("c.*", "target")
    fraction = F.least(F.col("target") / F.col("n_rows"), F.lit(float(most_copies)))
    return plan.withColumn("fraction", fraction)


def resample_hash(
    df: DataFrame, label: str, key: str, classes: Sequence[int] = CLASSES, most_copies: float = MAX_OVERSAMPLE
) -> DataFrame:
    """Balance the classes in one pass: a row gets floor(fraction) copies, plus one by its key's hash.

    The plan has at most ``len(classes)`` rows, which bounds its broadcast. The
    copies of a row are made where the row is; nothing is shuffled.
    """
    limited = resample_plan(df, label, classes, most_copies).select(label, "fraction")
    drawn = sha_bucket(F.col(key), HASH_RANGE) / F.lit(float(HASH_RANGE))
    whole = F.floor("fraction")
    copies = whole + F.when(drawn < F.col("fraction") - whole, 1).otherwise(0)
    joined = df.join(F.broadcast(limited), label).withColumn("_copies", copies).filter("_copies > 0")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies"))).drop(
        "_copies", "fraction"
    )


def _poisson_limits(mean: float) -> list[float]:
    """Chances of at most 0, 1, 2, … copies, until no double is left above."""
    limits, term = [math.exp(-mean)], math.exp(-mean)
    while limits[-1] < 1.0 and term > 1e-18:
        term *= mean / len(limits)
        limits.append(min(1.0, limits[-1] + term))
    return limits


def resample_random(
    df: DataFrame, label: str, classes: Sequence[int] = CLASSES, seed: int = 42, most_copies: float = MAX_OVERSAMPLE
) -> DataFrame:
    """The random form, in one scan: rows of a class that must shrink are drawn without repetition, those of
    one that must grow get a Poisson number of copies.

    Hand in a stored table: the draw depends on which rows are in which partition.
    """
    copies = F.lit(0)
    for row in resample_plan(df, label, classes, most_copies).collect():  # at most len(classes) rows
        fraction = row["fraction"]
        if fraction > 1.0:
            limits = F.array(*[F.lit(x) for x in _poisson_limits(fraction)])
            drawn = F.size(F.filter(limits, lambda x: x <= F.col("_drawn")))
        else:
            drawn = (F.col("_drawn") < F.lit(fraction)).cast("int")
        copies = F.when(F.col(label) == row[label], drawn).otherwise(copies)
    often = df.withColumn("_drawn", F.rand(seed)).withColumn("_copies", copies).filter("_copies > 0")
    return often.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_drawn", "_copies", "_copy")


def standardize(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame) -> DataFrame:
    """(x - mean) / population standard deviation of ``fitted_on``; a constant column becomes 0."""
    stats = fitted_on.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}_sd") for c in columns],
        )
    ).scalar()

    def scaled(c: str):
        centred, sd = F.col(c) - F.col(f"_fit.{c}_mean"), F.col(f"_fit.{c}_sd")
        return F.when(sd > 0, centred / sd).otherwise(centred)

    return df.withColumn("_fit", stats).withColumns({c: scaled(c) for c in columns}).drop("_fit")
