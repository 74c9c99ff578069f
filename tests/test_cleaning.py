import pytest
from pyspark.sql import functions as F

from riskloom.functions import cleaning as fn
from riskloom.functions.buckets import murmur_bucket, sha_bucket
from riskloom.functions.labels import decode_tier, encode_tier, softmax
from riskloom.functions.numeric import guarded_ratio, money_total
from riskloom.operators import cleaning, projecting
from riskloom.schemas import PAYMENT_COLUMNS, PRESCRIBER_COLUMNS, PRESCRIBER_NUMERIC
from riskloom.sources.readers import MissingColumns


def apply(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


CASES = [
    (
        fn.currency_amount,
        ["$1,234.56", "USD 7", "abc", None, "-5.0", "1.2.3", "."],
        [1.0, 7.0, 0.0, 0.0, 5.0, 0.0, 0.0],
    ),
    (
        lambda c: fn.currency_amount(c, strict=True),
        ["$1,234.56", "USD 7", "abc", None, "-5.0", "."],
        [1234.56, 7.0, 0.0, 0.0, -5.0, 0.0],
    ),
    (fn.zip5, ["02134-1234", "90210", "K1A 0B1", None, "1234"], ["02134", "90210", "", None, ""]),
    (
        fn.guarded_number,
        [None, "None", "12.5", "1.2E7", "-3", "1.2.3", ".", ""],
        [0.0, 0.0, 12.5, 0.0, 0.0, 0.0, 0.0, 0.0],
    ),
    (
        fn.coerced_number,
        [None, "x", " 1.5 ", "-2e3", "NaN", "12d", "1,5", ".5", "5."],
        [0.0, 0.0, 1.5, -2000.0, 0.0, 0.0, 0.0, 0.5, 5.0],
    ),
    (fn.safe_key, ["1003000126", "NA", None, "12.7", "99999999999999999999"], [1003000126, None, None, None, None]),
    (encode_tier, ["Low", "Medium", "High", "odd", None], [0, 1, 2, None, None]),
    (lambda c: encode_tier(c, other=2), ["Low", "odd", None], [0, 2, 2]),
    (decode_tier, ["0", "1.0", "2", "3", "text"], ["Low", "Medium", "High", "3.0", "text"]),
]


@pytest.mark.parametrize("expression, values, expected", CASES)
def test_text_expressions(spark, expression, values, expected):
    got = apply(spark, values, "string", expression)
    assert got == expected


def test_sha_bucket_known_values(spark):
    assert apply(spark, [0, 1, 2], "bigint", sha_bucket) == [2278, 9619, 554]
    assert apply(spark, [None], "bigint", sha_bucket) == apply(spark, [""], "string", sha_bucket)


def test_murmur_bucket_is_never_negative(spark):
    low, high = spark.range(20_000).select(murmur_bucket(F.col("id")).alias("b")).agg(F.min("b"), F.max("b")).first()
    assert 0 <= low and high < 10_000


def test_guarded_ratio(spark):
    df = spark.createDataFrame([(2.0, 0.0), (2.0, None), (2.0, 4.0), (2.0, -1.0)], "n double, d double")
    assert [r[0] for r in df.select(guarded_ratio(F.col("n"), F.col("d"))).collect()] == [0.0, 0.0, 0.5, 0.0]


def test_money_total_is_exact_and_refuses_amounts_that_do_not_fit(spark):
    cents = spark.range(0, 100_000, 1, 7).select(F.lit(0.1).alias("a"))
    assert cents.agg(money_total(F.col("a"))).first()[0] == 10_000.0
    small = spark.range(1000).select(F.lit(0.004).alias("a"))
    assert small.agg(money_total(F.col("a"))).first()[0] == 4.0
    full = spark.createDataFrame([(8e16,), (8e16,), (None,)], "a double")
    assert full.agg(money_total(F.col("a"))).first()[0] == 1.6e17
    huge = spark.createDataFrame([(1e30,), (0.25,)], "a double")
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        huge.agg(money_total(F.col("a"))).first()
    assert spark.createDataFrame([(None,)], "a double").agg(money_total(F.col("a"))).first()[0] is None


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0],), ([-1000.0, -1000.0, -1000.0],)], "s array<double>")
    first, second = [r[0] for r in df.select(softmax(F.col("s"))).collect()]
    assert abs(sum(first) - 1) < 1e-12 and first[0] < first[1] < first[2]
    assert second == [0.0, 0.0, 0.0]


def test_typed_numbers_are_not_read_as_text(spark):
    df = spark.createDataFrame([(1.2345678e7,), (None,)], "Payment_Amount double")
    assert [r[0] for r in cleaning.clean_amount(df).collect()] == [1.2345678e7, 0.0]
    df = spark.createDataFrame([(1.2e7,), (None,)], "total_claims double")
    assert [r[0] for r in cleaning.guard_numeric(df, ["total_claims"]).collect()] == [1.2e7, 0.0]


def test_clean_prescribers_keeps_every_row(spark):
    raw = {c: "7" for c in PRESCRIBER_COLUMNS}
    rows = [raw, raw | {"PRSCRBR_NPI": "NA", "Prscrbr_Crdntls": None, "Tot_Clms": "None"}, raw | {"PRSCRBR_NPI": None}]
    schema = ", ".join(f"{c} string" for c in PRESCRIBER_COLUMNS)
    df = spark.createDataFrame([tuple(r[c] for c in PRESCRIBER_COLUMNS) for r in rows], schema)
    clean = cleaning.clean_prescribers(df)
    got = clean.collect()
    assert len(clean.columns) == 21
    assert [r["prescriber_id"] for r in got] == [7, None, None]
    assert got[1]["credentials"] == "NA" and got[1]["total_claims"] == 0.0
    assert {t for c, t in clean.dtypes if c in PRESCRIBER_NUMERIC} == {"double"}


def test_project_payments_needs_its_columns(spark):
    with pytest.raises(MissingColumns):
        projecting.project_payments(spark.createDataFrame([("1",)], "Covered_Recipient_NPI string"))
    assert len(set(PAYMENT_COLUMNS.values())) == 18


def test_ensure_and_select_present(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b double, c string")
    row = projecting.ensure_features(df, ["a", "b", "z"]).first()
    assert (row["a"], row["b"], row["z"]) == (1.0, 0.0, 0.0)
    assert projecting.select_present(df, ["c", "nope", "a"]).columns == ["c", "a"]


def test_union_parts_matches_columns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([("y", 2)], "v string, k int")
    assert sorted(tuple(r) for r in projecting.union_parts([a, b]).collect()) == [(1, "x"), (2, "y")]


def test_features_lose_nan_and_text_that_is_no_decimal(spark):
    df = spark.createDataFrame([(float("nan"), "12d", "1.5e1"), (2.0, "0x1p3", None)], "a double, b string, c string")
    rows = projecting.ensure_features(df, ["a", "b", "c", "d"]).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0, 15.0, 0.0), (2.0, 0.0, 0.0, 0.0)]
