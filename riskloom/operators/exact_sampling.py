"""Class balancing to exact sizes: the k rows with the least hashes of a class, found without sorting it.

A row's order is its key's hash, then its own number, as hexadecimal text; no two rows share one. The
k-th least is found digit by digit: rows are counted per class and next digits, the digits in which the
k-th row lies are kept, and only rows that start with them are counted further. A pass returns
at most ``len(classes)`` times 4096 counts, and a few passes settle any number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.sampling import CLASSES, MAX_OVERSAMPLE, resample_plan
from riskloom.sources.staging import stage

#: Hexadecimal digits of the hash, of the row number, and of one pass.
HASH_DIGITS, ROW_DIGITS, STEP = 16, 16, 3
# Keeps the draw apart from splits and samples by the same key.
SALT = "balance:"


def with_order(df: DataFrame, key: str) -> DataFrame:
    """Add ``_order``; the result is stored, so that row numbers stay as they are."""
    salted = F.concat(F.lit(SALT), F.coalesce(F.col(key).cast("string"), F.lit("")))
    number = F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), ROW_DIGITS, "0")
    return stage(df.withColumn("_order", F.concat(F.substring(F.sha2(salted, 256), 1, HASH_DIGITS), number)), "ordered")


def least_bounds(df: DataFrame, label: str, wanted: Mapping[int, int]) -> dict[int, str]:
    """For each class, text such that exactly the wanted number of rows have an ``_order`` that starts no higher.

    A class is left out where nothing is wanted; it must have as many rows as are wanted.
    """
    left = {c: n for c, n in wanted.items() if n > 0}
    prefix = dict.fromkeys(left, "")
    found: dict[int, str] = {}
    while left:
        length = len(next(iter(prefix.values())))
        inside = None
        for c, p in prefix.items():
            here = (F.col(label) == c) & F.col("_order").startswith(p)
            inside = here if inside is None else inside | here
        digits = F.substring("_order", length + 1, STEP).alias("digits")
        counts = df.filter(inside).groupBy(label, digits).agg(F.count(F.lit(1)).alias("n")).orderBy(label, "digits").collect()
        for row in counts:
            c = row[label]
            if c not in left or len(prefix[c]) > length:  # settled, by this pass or for good
                continue
            if row["n"] < left[c]:
                left[c] -= row["n"]
            elif row["n"] == left[c]:
                found[c] = prefix.pop(c) + row["digits"]
                del left[c]
            else:
                prefix[c] += row["digits"]
        if any(len(p) == length for p in prefix.values()):
            raise ValueError("a class has fewer rows than are wanted of it")
    return found


def resample_exact(
    df: DataFrame, label: str, key: str, classes: Sequence[int] = CLASSES, most_copies: float = MAX_OVERSAMPLE
) -> DataFrame:
    """Every class with exactly the mean class size, or ``most_copies`` times its own if that is less.

    Every row gets the whole copies, and the rows that come first by hash one more; ``copy`` numbers them.
    """
    ordered = with_order(df, key)
    plan = resample_plan(ordered, label, classes, most_copies).collect()  # at most len(classes) rows
    sizes = {r[label]: min(int(r["target"]), int(most_copies * r["n_rows"])) for r in plan}
    whole = {r[label]: sizes[r[label]] // r["n_rows"] for r in plan}
    bounds = least_bounds(ordered, label, {r[label]: sizes[r[label]] % r["n_rows"] for r in plan})
    copies = F.lit(0)
    for c, n in whole.items():
        more = F.lit(0)
        if c in bounds:
            more = (F.substring("_order", 1, len(bounds[c])) <= bounds[c]).cast("int")
        copies = F.when(F.col(label) == c, F.lit(n) + more).otherwise(copies)
    often = ordered.withColumn("_copies", copies.cast("bigint")).filter("_copies > 0").drop("_order")
    return often.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies"))).drop("_copies")
