import pytest
from pyspark.sql import functions as F

from riskloom.operators import features, joining
from riskloom.schemas import PAYMENT_COLUMNS
from riskloom.sources.readers import MissingColumns
from riskloom.sources.staging import stage


def payments(spark, rows):
    df = spark.createDataFrame(rows, "NPI string, Payment_Amount double")
    return df.withColumns({c: F.lit("x") for c in PAYMENT_COLUMNS.values() if c not in df.columns})


def prescribers(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "prescriber_id bigint")
    text = ["first_name", "last_name", "city", "state", "zip", "provider_type"]
    return df.withColumns({c: F.lit(c) for c in text})


def test_payment_aggregates(spark):
    rows = payments(spark, [("1", 10.0), ("1", 20.1), (None, 5.0), ("NA", 1.0)])
    got = {r["NPI"]: tuple(r)[1:] for r in joining.payment_aggregates(rows).collect()}
    assert got["1"] == (30.1, 2, 15.05, 20.1)
    assert got[None] == (5.0, 1, 5.0, 5.0) and got["NA"] == (1.0, 1, 1.0, 1.0)


def test_prescriber_level_keeps_every_prescriber(spark):
    paid = payments(spark, [("1", 10.0), (" 1", 2.0), (None, 5.0), ("NA", 9.0)])
    level = joining.prescriber_level(prescribers(spark, [1, 2, None, None]), joining.payment_summary(paid))
    got = sorted((r["prescriber_id"] or 0, r["total_payment_amount"], r["num_payments"]) for r in level.collect())
    assert got == [(0, 0.0, 0), (0, 0.0, 0), (1, 12.0, 2), (2, 0.0, 0)]


def test_payment_level_keeps_payments_with_numeric_keys(spark):
    paid = payments(spark, [("1", 10.0), ("3", 2.0), (None, 5.0), ("NA", 9.0)])
    merged = joining.payment_level(paid, prescribers(spark, [1, 2, None]))
    got = {r["NPI"]: r["provider_type"] for r in merged.collect()}
    assert got == {"1": "provider_type", "3": None}
    assert not {"first_name", "city", "_npi", "_id"} & set(merged.columns)


@pytest.fixture
def no_broadcast(spark):
    """Nothing may be broadcast, and partitions count as skewed at the size of these tests."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512KB",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


ROWS = 600_000


def hot_rows(spark, hot, other, **columns):
    """A third of the rows share one key."""
    key = F.when(F.col("id") % 3 == 0, hot).otherwise(other)
    filler = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(0, ROWS, 1, 24).select(key.alias("key"), filler.alias("filler"), *[v.alias(k) for k, v in columns.items()])


def check_split(joined, expected):
    counted = joined.agg(F.count(F.lit(1)), F.count("filler"), F.max("filler"), *expected)
    row = counted.collect()[0]
    assert row[0] == row[1] == ROWS
    assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    return tuple(row)[3:]


def test_hot_recipient_is_split(spark, no_broadcast):
    other = (F.col("id") % 50_000).cast("string")
    rows = hot_rows(spark, F.lit("7"), other, Payment_Amount=F.lit(1.0)).withColumnRenamed("key", "NPI")
    people = spark.range(50_000).select(F.col("id").alias("prescriber_id"), F.lit("t").alias("provider_type"))
    merged = joining.payment_level(rows, stage(people, "people"))
    assert check_split(merged, [F.count("provider_type")]) == (ROWS,)


def test_prescribers_without_an_identifier_are_split(spark, no_broadcast):
    people = hot_rows(spark, F.lit(None).cast("bigint"), F.col("id")).withColumnRenamed("key", "prescriber_id")
    paid = spark.range(0, ROWS, 2).select(F.col("id").cast("string").alias("NPI"), F.lit(2.5).alias("Payment_Amount"))
    level = joining.prescriber_level(people, stage(joining.payment_summary(paid), "summary"))
    paid_once = ROWS // 2 - ROWS // 6  # even identifiers that are not multiples of three
    assert check_split(level, [F.sum("num_payments"), F.sum("total_payment_amount")]) == (paid_once, 2.5 * paid_once)


def test_hot_peer_group_is_split(spark, no_broadcast):
    group = F.concat(F.lit("g"), (F.col("id") % 5_000).cast("string"))
    level = hot_rows(spark, F.lit("big"), group, avg_payment_amount=F.lit(4.0)).withColumnRenamed("key", "provider_type")
    compared = features.add_peer_deviation(level, stage(features.peer_average(level), "peers"))
    assert check_split(compared, [F.sum("peer_deviation_score")]) == (float(ROWS),)


def test_join_predictions_suffixes_and_decodes(spark):
    uploads = spark.createDataFrame([("1", "a"), ("2", "b")], "prescriber_id string, state string")
    stored = spark.createDataFrame([("1", "z", 2.0)], "prescriber_id string, state string, prediction double")
    got = {r["prescriber_id"]: r for r in joining.join_predictions(uploads, stored).collect()}
    assert (got["1"]["state_x"], got["1"]["state_y"], got["1"]["predicted_category"]) == ("a", "z", "High")
    assert got["2"]["state_x"] == "b" and got["2"]["predicted_category"] is None
    with pytest.raises(MissingColumns):
        joining.join_predictions(uploads.drop("prescriber_id"), stored)


def test_lookup(spark):
    stored = spark.createDataFrame([(1, "Low")], "prescriber_id bigint, predicted_category string")
    asked = spark.createDataFrame([("1",), ("x",)], "prescriber_id string")
    got = {r["prescriber_id"]: (r["predicted_category"], r["matched"]) for r in joining.lookup(asked, stored).collect()}
    assert got == {"1": ("Low", True), "x": (None, False)}
    assert joining.lookup_one(stored, "1").count() == 1 and joining.lookup_one(stored, "9").count() == 0
