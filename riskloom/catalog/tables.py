"""The given star-schema tables read as raw prescriber and payment tables.

A customer stands for a prescriber, their line items for claims, and events for
payments. Column by column the mapping is restated in SQL in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.cleaning import clean_payments, clean_prescribers
from riskloom.operators.rules import RiskThresholds
from riskloom.plans.etl import score_prescribers
from riskloom.schemas import PAYMENT_COLUMNS, PRESCRIBER_COLUMNS, PRESCRIBER_NUMERIC, SCORING_RANGES

# With these every rule fires on the given tables; the published ones leave three silent.
THRESHOLDS = RiskThresholds(payment_to_cost=0.003, opioid_claims=25.0, average_payment=54.0)

# The accepted ranges of scoring inputs, some so narrow that the given tables exceed them.
TIGHT_RANGES = SCORING_RANGES | {"total_claims": (0.0, 100.0), "payment_variability": (0.0, 2.0), "peer_deviation_score": (0.0, 1.0)}

# The columns the mapping reads. A declared schema saves a job per table to look it up.
TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "lineitem": "l_orderkey bigint, l_quantity double, l_extendedprice double, l_discount double, "
    "l_returnflag string, l_linestatus string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ITEM = [
    "l_orderkey",
    "l_linestatus",
    "l_returnflag = 'R' as opioid",
    "l_returnflag = 'A' as antibiotic",
    "cast(rint(l_extendedprice * 100) as bigint) as price",
    "cast(l_quantity as bigint) as quantity",
    "cast(rint(l_discount * 100) as bigint) as discount",
]

ORDER_TOTALS = {
    "items": "count(1)",
    "cost": "sum(price)",
    "opioid_items": "count_if(opioid)",
    "opioid_cents": "sum(price) filter (where opioid)",
    "antibiotic_items": "count_if(antibiotic)",
    "antibiotic_cents": "sum(price) filter (where antibiotic)",
    "quantity": "sum(quantity)",
    "discount": "sum(discount)",
    "female": "count_if(l_linestatus = 'F')",
    "male": "count_if(l_linestatus = 'O')",
}


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim totals per customer.

    Line items shrink to one row per order before anything is joined, so an order
    counts once without a distinct count, and no raw line item is shuffled.
    """
    items = table(spark, sf_dir, "lineitem").selectExpr(*ITEM)
    per_order = items.groupBy("l_orderkey").agg(*[F.expr(e).alias(n) for n, e in ORDER_TOTALS.items()])
    joined = table(spark, sf_dir, "orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_custkey").agg(
        *[F.expr(f"sum({n})").alias(n) for n in ORDER_TOTALS],
        F.expr("count(1)").alias("orders"),
        F.expr("count_if(opioid_items > 0)").alias("opioid_orders"),
    )


PRESCRIBER = {
    "prescriber_id": "cast(c_custkey as string)",
    "first_name": "split_part(c_name, '#', 1)",
    "last_name": "split_part(c_name, '#', 2)",
    "credentials": "case c_custkey % 3 when 0 then 'MD' when 1 then 'DO' end",
    "provider_type": "c_mktsegment",
    "state": "n_name",
    "city": "concat('City ', c_custkey % 97)",
    "zip": "lpad((c_custkey * 613 + 7) % 100000, 5, '0')",
    "total_claims": "cast(coalesce(items, 0) as double)",
    "total_drug_cost": "coalesce(cost, 0) / 100D",
    "total_beneficiaries": "cast(coalesce(orders, 0) as double)",
    "opioid_claims": "cast(coalesce(opioid_items, 0) as double)",
    "opioid_cost": "coalesce(opioid_cents, 0) / 100D",
    "opioid_beneficiaries": "cast(coalesce(opioid_orders, 0) as double)",
    "opioid_rate": "100D * opioid_items / items",
    "antibiotic_claims": "cast(coalesce(antibiotic_items, 0) as double)",
    "antibiotic_cost": "coalesce(antibiotic_cents, 0) / 100D",
    "avg_patient_age": "cast(items * 45 + quantity as double) / items",
    "female_patients": "cast(coalesce(female, 0) as double)",
    "male_patients": "cast(coalesce(male, 0) as double)",
    "avg_risk_score": "cast(discount as double) / (items * 5)",
}


def raw_prescribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 raw columns; text and numbers may be null, as in a typed scan of the source file."""
    c = F.col
    people = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey")
    )
    joined = people.join(_claims(spark, sf_dir), c("c_custkey") == c("o_custkey"), "left")
    return joined.selectExpr(*[f"{PRESCRIBER[clean]} as {raw}" for raw, clean in PRESCRIBER_COLUMNS.items()])


def _untidy(column: str, shift: int) -> str:
    """A number as text: by turns with a currency sign, an exponent, null, "None", a sign, a fraction,
    two points, plain."""
    text = f"floor({column})"
    return f"""case (cast(PRSCRBR_NPI as bigint) + {shift}) % 8 when 0 then concat('$', {text})
        when 1 then concat({text}, 'E2') when 2 then null when 3 then 'None' when 4 then concat('-', {text})
        when 5 then concat({text}, '.5') when 6 then concat({text}, '.5.1') else cast({text} as string) end"""


def raw_prescribers_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw prescribers with their numbers as untidy text."""
    untidy = {
        raw: _untidy(raw, PRESCRIBER_NUMERIC.index(clean)) if clean in PRESCRIBER_NUMERIC else raw
        for raw, clean in PRESCRIBER_COLUMNS.items()
    }
    return raw_prescribers(spark, sf_dir).selectExpr(*[f"{e} as {raw}" for raw, e in untidy.items()])


AMOUNT_TEXT = """case event_id % 8 when 0 then concat('$', value) when 1 then concat('USD ', value)
    when 3 then 'None' when 4 then 'n/a' when 5 then concat('-', value) when 6 then concat('1,', value)
    when 7 then cast(value as string) end"""
ZIP_DIGITS = "lpad((user_id * 613 + 7) % 100000, 5, '0')"
ZIP_TEXT = f"""case event_id % 4 when 0 then {ZIP_DIGITS} when 1 then concat({ZIP_DIGITS}, '-1234')
    when 2 then 'K1A 0B1' end"""
KEY_TEXT = "case when event_id % 16 = 0 then 'NA' when event_id % 16 <> 1 then cast(user_id as string) end"

PAYMENT = {
    "NPI": "cast(user_id as string)",
    "First_Name": "'User'",
    "Last_Name": "cast(user_id as string)",
    "Specialty": "event_type",
    "City": "concat('City ', user_id % 97)",
    "State": "concat('NATION_', user_id % 25)",
    "Zip": ZIP_TEXT,
    "Payment_Amount": "value",
    "Payment_Date": "cast(cast(ts as date) as string)",
    "Payment_Form": "case event_id % 3 when 0 then 'Cash' when 1 then 'In-kind' else 'Stock' end",
    "Payment_Nature": "event_type",
    "Manufacturer": "concat('Maker ', event_id % 40)",
    "Drug_or_Device": "case when event_id % 5 <> 0 then concat('Drug ', event_id % 200) end",
    "Therapeutic_Area": "concat('Area ', event_id % 12)",
    "Ownership": "if(event_id % 20 = 0, 'Yes', 'No')",
    "Third_Party_Recipient": "if(event_id % 11 = 0, 'Entity', 'No Third Party Payment')",
    "Charity": "if(event_id % 30 = 0, 'Yes', 'No')",
    "Dispute_Status": "'No'",
}


def raw_payments(spark: SparkSession, sf_dir: str, untidy: bool = False) -> DataFrame:
    """18 raw columns; ``untidy`` gives amounts and recipient keys as they come in dirty text."""
    columns = PAYMENT | ({"NPI": KEY_TEXT, "Payment_Amount": AMOUNT_TEXT} if untidy else {})
    events = table(spark, sf_dir, "events")
    return events.selectExpr(*[f"{columns[clean]} as {raw}" for raw, clean in PAYMENT_COLUMNS.items()])


def prescribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_prescribers(raw_prescribers(spark, sf_dir))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_payments(raw_payments(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_prescribers(prescribers(spark, sf_dir), payments(spark, sf_dir), THRESHOLDS)


def surrogate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-class label and a rule that imitates a model, for metrics that need no fit."""
    return prescribers(spark, sf_dir).selectExpr(
        "prescriber_id",
        "provider_type",
        "state",
        "total_claims",
        "case when opioid_claims > 25 then 2 when avg_patient_age > 70 then 1 else 0 end as fraud_label",
        "case when total_claims > 60 then 2 when avg_patient_age > 71 then 1 else 0 end as prediction",
    )
