"""Engineered columns at prescriber level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numeric import guarded_ratio
from riskloom.operators.rules import RiskThresholds

PEER_GROUP = "provider_type"


def ratio_features(df: DataFrame) -> DataFrame:
    """Columns that depend on the prescriber-level table alone."""
    c = F.col
    return df.withColumns(
        {
            "payment_per_claim": guarded_ratio(c("total_payment_amount"), c("total_claims")),
            "payment_to_drug_cost_ratio": guarded_ratio(c("total_payment_amount"), c("total_drug_cost")),
            "opioid_claim_ratio": guarded_ratio(c("opioid_claims"), c("total_claims")),
            "antibiotic_claim_ratio": guarded_ratio(c("antibiotic_claims"), c("total_claims")),
            "payment_variability": guarded_ratio(c("max_payment_amount"), c("avg_payment_amount")),
            "female_to_male_ratio": guarded_ratio(c("female_patients"), c("male_patients")),
            "adjusted_risk_payment": c("total_payment_amount") * c("avg_risk_score"),
        }
    )


def flag_features(df: DataFrame, thresholds: RiskThresholds) -> DataFrame:
    """0/1 flags; every threshold is strict, and null counts as not above it."""

    def above(column: str, limit: float):
        return F.when(F.col(column) > limit, 1).otherwise(0)

    return df.withColumns(
        {
            "high_opioid_flag": above("opioid_claim_ratio", thresholds.opioid_share),
            "high_payment_flag": above("avg_payment_amount", thresholds.average_payment),
            "elderly_focus_flag": above("avg_patient_age", thresholds.patient_age),
        }
    )


def add_features(df: DataFrame, thresholds: RiskThresholds = RiskThresholds()) -> DataFrame:
    return flag_features(ratio_features(df), thresholds)


def peer_average(df: DataFrame) -> DataFrame:
    """Mean of the average payment per peer group, prescribers without payments included."""
    return df.groupBy(PEER_GROUP).agg(F.avg("avg_payment_amount").alias("peer_avg_payment"))


def add_peer_deviation(df: DataFrame, peers: DataFrame) -> DataFrame:
    """Average payment relative to the peer mean; a null group has no peers and gets 0.

    Hand in ``peers`` as a stored or staged table. Usually it is small and the
    planner broadcasts it by its file size; if not, both sides are shuffled and a
    group that holds much of the table is split by adaptive execution.
    """
    return df.join(peers, PEER_GROUP, "left").withColumn(
        "peer_deviation_score", guarded_ratio(F.col("avg_payment_amount"), F.col("peer_avg_payment"))
    )
