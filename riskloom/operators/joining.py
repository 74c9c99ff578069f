"""Payment summaries and the two merged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.cleaning import safe_key
from riskloom.functions.labels import decode_tier
from riskloom.functions.numeric import money_total
from riskloom.operators.cleaning import valid_keys
from riskloom.schemas import PAYMENT_SUMMARY_COLUMNS
from riskloom.sources.readers import require_columns


def payment_aggregates(payments: DataFrame, key: str = "NPI", amount: str = "Payment_Amount") -> DataFrame:
    """Sum, count, mean and maximum of the payments of each key.

    Every aggregate is combined before the shuffle, so a key that holds a third
    of all payments sends one row per map task.
    """
    value = F.col(amount)
    sums = payments.groupBy(key).agg(
        money_total(value).alias("total_payment_amount"),
        F.count(value).alias("num_payments"),
        F.max(value).alias("max_payment_amount"),
    )
    mean = F.when(F.col("num_payments") > 0, F.col("total_payment_amount") / F.col("num_payments"))
    return sums.withColumn("avg_payment_amount", mean).select(key, *PAYMENT_SUMMARY_COLUMNS)


def payment_summary(payments: DataFrame) -> DataFrame:
    """``payment_aggregates`` by numeric recipient key; other keys can never be joined."""
    keyed = payments.select(safe_key(F.col("NPI")).alias("NPI"), "Payment_Amount")
    return payment_aggregates(keyed.filter(F.col("NPI").isNotNull()))


def prescriber_level(prescribers: DataFrame, summary: DataFrame) -> DataFrame:
    """Every prescriber with the summary of their payments, 0 where there are none.

    Payments arrive here already reduced to one row per recipient. Hand in
    ``summary`` as a stored or staged table: its size then decides between a
    broadcast and a sort-merge join, and rows that share one identifier, or have
    none, are split by adaptive execution instead of filling one task.
    """
    joined = prescribers.join(
        summary.withColumnRenamed("NPI", "_npi"), F.col("prescriber_id") == F.col("_npi"), "left"
    )
    return joined.drop("_npi").fillna(0, subset=PAYMENT_SUMMARY_COLUMNS)


def payment_level(payments: DataFrame, prescribers: DataFrame) -> DataFrame:
    """Every payment with a numeric key, with the prescriber's columns where known.

    Hand in ``prescribers`` as a stored or staged table: then both join inputs
    are direct shuffles and adaptive execution splits the partition of a recipient
    with very many payments, or broadcasts the prescribers if they are small.
    """
    people = valid_keys(
        prescribers.drop("first_name", "last_name", "city", "state", "zip"), "prescriber_id", "_id"
    )
    paid = valid_keys(payments, "NPI", "_npi")
    return paid.join(people, F.col("_npi") == F.col("_id"), "left").drop("_npi", "_id")


def join_predictions(
    uploads: DataFrame, predictions: DataFrame, suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Uploaded records with the stored prediction of the same prescriber, if any.

    Columns on both sides get a suffix each. Stored predictions without a tier
    name get one from their code.
    """
    key = "prescriber_id"
    require_columns(uploads, [key], "uploads")
    both = [c for c in uploads.columns if c in predictions.columns and c != key]
    left = uploads.withColumnsRenamed({c: c + suffixes[0] for c in both})
    right = predictions.withColumnsRenamed({c: c + suffixes[1] for c in both})
    merged = left.join(right, key, "left")
    if "predicted_category" not in merged.columns and "prediction" in merged.columns:
        merged = merged.withColumn("predicted_category", decode_tier(F.col("prediction")))
    return merged


def lookup(records: DataFrame, predictions: DataFrame, key: str = "prescriber_id") -> DataFrame:
    """The stored prediction of each requested key, and whether there is one.

    The requested text is read as the stored key's type, so the stored table is matched by its
    own column; text that is not one matches nothing and comes back as it was asked for.
    """
    require_columns(records, [key], "lookup")
    kind = predictions.schema[key].dataType
    wanted = records.select(F.col(key).cast("string").alias(key), F.col(key).try_cast(kind).alias("_key"))
    stored = predictions.withColumnRenamed(key, "_stored").withColumn("matched", F.lit(True))
    # "007" is no stored key's own text, so it must not match 7.
    same = (F.col("_key") == F.col("_stored")) & (F.col("_stored").cast("string") == F.col(key))
    found = wanted.join(stored, same, "left").drop("_key", "_stored")
    return found.withColumn("matched", F.coalesce("matched", F.lit(False)))


def lookup_one(predictions: DataFrame, value: str, key: str = "prescriber_id") -> DataFrame:
    """The stored row of one key; the value is cast, not the column, so files can be skipped."""
    asked = F.lit(str(value)).try_cast(predictions.schema[key].dataType)
    return predictions.filter(F.col(key) == asked)
