"""Transparent risk rules, tiers and the explanation of each result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.labels import TIERS


# The published thresholds.
@dataclass(frozen=True)
class RiskThresholds:
    payment_to_cost: float = 1.0
    opioid_claims: float = 100.0
    average_payment: float = 1000.0
    opioid_share: float = 0.5
    peer_deviation: float = 5.0
    patient_age: float = 70.0


@dataclass(frozen=True)
class Rule:
    name: str
    detail: str
    points: int
    fires: Column


def _most(share: float) -> str:
    return "More than half" if share == 0.5 else f"More than {share:.0%}"


def risk_rules(t: RiskThresholds = RiskThresholds()) -> list[Rule]:
    """The rules in order of precedence. A null input counts as 0."""

    def value(column: str) -> Column:
        return F.coalesce(F.col(column).cast("double"), F.lit(0.0))

    # Rule names, explanations and points.
    return [
        Rule(
            "High payment vs drug cost",
            f"Industry payments exceed total drug cost (ratio > {t.payment_to_cost:g}).",
            2,
            value("payment_to_drug_cost_ratio") > t.payment_to_cost,
        ),
        Rule(
            "Heavy opioid prescribing",
            f"Opioid claim count is above {t.opioid_claims:g}.",
            2,
            value("opioid_claims") > t.opioid_claims,
        ),
        Rule(
            "High payment flag",
            "Average payment size is flagged as unusually high.",
            2,
            value("high_payment_flag") == 1,
        ),
        Rule(
            "High opioid flag",
            f"{_most(t.opioid_share)} of claims are opioid-related.",
            2,
            value("high_opioid_flag") == 1,
        ),
        Rule(
            "Peer payment outlier",
            "Payment level is far above peers in the same provider type.",
            2,
            value("peer_deviation_score") > t.peer_deviation,
        ),
        Rule(
            "Elderly-focused practice",
            f"Average patient age is above {t.patient_age:g}.",
            1,
            value("elderly_focus_flag") == 1,
        ),
    ]


def score(df: DataFrame, thresholds: RiskThresholds = RiskThresholds()) -> DataFrame:
    """Points of the first rule that fires, and the tier they stand for."""
    first, *others = risk_rules(thresholds)
    points = F.when(first.fires, first.points)
    for rule in others:
        points = points.when(rule.fires, rule.points)
    scored = df.withColumn("fraud_risk_score", points.otherwise(0))
    tier = F.when(F.col("fraud_risk_score") >= 2, TIERS[2]).when(F.col("fraud_risk_score") == 1, TIERS[1])
    return scored.withColumn("fraud_risk_category", tier.otherwise(TIERS[0]))


def with_fired_rules(df: DataFrame, thresholds: RiskThresholds = RiskThresholds()) -> DataFrame:
    """Add ``fired_rules``: every rule that fires, as an array of (name, detail)."""
    checks = [
        F.when(rule.fires, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.detail).alias("detail")))
        for rule in risk_rules(thresholds)
    ]
    return df.withColumn("fired_rules", F.array_compact(F.array(*checks)))


def fired_rules(df: DataFrame, thresholds: RiskThresholds = RiskThresholds(), key: str = "prescriber_id") -> DataFrame:
    """One row per prescriber and fired rule."""
    flagged = with_fired_rules(df, thresholds)
    return flagged.select(key, F.inline("fired_rules")).toDF(key, "rule_name", "rule_detail")


def rule_hits(df: DataFrame, thresholds: RiskThresholds = RiskThresholds()) -> DataFrame:
    """Rows per fired rule; rows on which no rule fires are counted as "none"."""
    flagged = with_fired_rules(df, thresholds)
    names = flagged.select(F.explode_outer("fired_rules").alias("rule"))
    return names.groupBy(F.coalesce("rule.name", F.lit("none")).alias("rule_name")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def risk_distribution(df: DataFrame, tier: str = "fraud_risk_category") -> DataFrame:
    return df.groupBy(tier).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), tier)
