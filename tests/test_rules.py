import itertools

from pyspark.sql import functions as F

from riskloom.operators import auditing, features, rules
from riskloom.schemas import RULE_INPUTS, SCORING_RANGES

COLUMNS = "prescriber_id int, " + ", ".join(f"{c} double" for c in RULE_INPUTS)
LIMITS = {
    "payment_to_drug_cost_ratio": 1.0,
    "opioid_claims": 100.0,
    "high_payment_flag": 0.0,
    "high_opioid_flag": 0.0,
    "peer_deviation_score": 5.0,
    "elderly_focus_flag": 0.0,
}


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS)


def test_every_combination_of_rules(spark):
    """The first rule that fires gives the same points as the greatest of those that fire."""
    choices = list(itertools.product([0, 1], repeat=6))
    on = {"payment_to_drug_cost_ratio": 1.01, "opioid_claims": 101.0, "peer_deviation_score": 5.1}
    rows = [tuple(on.get(c, 1.0) if bit else 0.0 for c, bit in zip(RULE_INPUTS, bits)) for bits in choices]
    points = dict(zip(RULE_INPUTS, [2, 2, 2, 2, 2, 1]))
    scored = rules.with_fired_rules(rules.score(frame(spark, rows))).orderBy("prescriber_id").collect()
    for bits, row in zip(choices, scored):
        fired = [points[c] for c, bit in zip(RULE_INPUTS, bits) if bit]
        assert row["fraud_risk_score"] == max(fired, default=0)
        assert row["fraud_risk_category"] == ["Low", "Medium", "High"][row["fraud_risk_score"]]
        assert len(row["fired_rules"]) == sum(bits)


def test_thresholds_are_strict_and_null_fires_nothing(spark):
    rows = [tuple(LIMITS[c] for c in RULE_INPUTS), (None,) * 6]
    scored = rules.score(frame(spark, rows)).collect()
    assert [r["fraud_risk_score"] for r in scored] == [0, 0]
    hits = {r[0]: r[1] for r in rules.rule_hits(frame(spark, rows)).collect()}
    assert hits == {"none": 2}


def test_flag_thresholds_are_strict(spark):
    df = spark.createDataFrame(
        [(0.5, 1000.0, 70.0), (0.51, 1000.01, 70.01), (None, None, None)],
        "opioid_claim_ratio double, avg_payment_amount double, avg_patient_age double",
    )
    flags = features.flag_features(df, rules.RiskThresholds())
    got = [tuple(r)[3:] for r in flags.collect()]
    assert got == [(0, 0, 0), (1, 1, 1), (0, 0, 0)]


def test_fired_rule_texts(spark):
    row = rules.fired_rules(frame(spark, [(2.0, 0.0, 0.0, 0.0, 0.0, 0.0)])).first()
    assert row["rule_name"] == "High payment vs drug cost"
    assert row["rule_detail"] == "Industry payments exceed total drug cost (ratio > 1)."


def test_peer_deviation(spark):
    df = spark.createDataFrame(
        [(1, "a", 0.0), (2, "a", 10.0), (3, "b", 0.0), (4, None, 7.0)],
        "prescriber_id int, provider_type string, avg_payment_amount double",
    )
    out = features.add_peer_deviation(df, features.peer_average(df)).collect()
    got = {r["prescriber_id"]: (r["peer_avg_payment"], r["peer_deviation_score"]) for r in out}
    assert got == {1: (5.0, 0.0), 2: (5.0, 2.0), 3: (0.0, 0.0), 4: (None, 0.0)}


def test_validate_ranges(spark):
    df = spark.createDataFrame(
        [("1", ""), ("200001", "6"), ("x", None), (" 12 ", "5"), ("-1", "NaN")],
        "total_claims string, avg_risk_score string",
    )
    got = [(r["errors"], r["is_valid"]) for r in auditing.validate_ranges(df).collect()]
    assert got[0] == ([], True) and got[3] == ([], True)
    assert got[1][0] == [
        "total_claims: must be between 0 and 200,000.",
        "avg_risk_score: must be between 0 and 5.",
    ]
    assert got[2][0] == ["total_claims: enter a valid number."]
    assert got[4][0] == ["total_claims: must be between 0 and 200,000.", "avg_risk_score: enter a valid number."]
    parsed = auditing.parse_ranges(df).collect()
    assert [tuple(r) for r in parsed] == [(1.0, 0.0), (12.0, 5.0)]
    assert len(SCORING_RANGES) == 13


def test_audits(spark):
    df = spark.createDataFrame(
        [("1.5", "02134", "1E5"), ("$2", "02134-1", "a,b"), (None, None, None), ("-3", "", "5:D")],
        "Payment_Amount string, Zip string, n string",
    )
    counts = {
        r[0]: r[1]
        for r in auditing.audit_non_numeric(
            df, {"Payment_Amount": auditing.SIGNED_DECIMAL, "Zip": auditing.DIGITS}
        ).collect()
    }
    assert counts == {"Payment_Amount": 1, "Zip": 2}
    assert auditing.non_numeric_rows(df, "Payment_Amount", auditing.SIGNED_DECIMAL).count() == 1
    assert {r[0]: r[1] for r in auditing.audit_post_clean(df).collect()} == {"Payment_Amount": 2, "Zip": 2}
    assert {r[0]: r[1] for r in auditing.audit_residual_chars(df, ["n"]).collect()} == {"n": 2}
    assert auditing.bad_keys(df, "Zip").count() == 3


def test_distribution_is_ordered(spark):
    df = spark.createDataFrame([("Low",), ("High",), ("High",)], "fraud_risk_category string")
    assert [tuple(r) for r in rules.risk_distribution(df).collect()] == [("High", 2), ("Low", 1)]
    assert df.select(F.count("*")).first()[0] == 3
