"""From the two raw tables to scored prescribers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators import features as feat
from riskloom.operators import joining
from riskloom.operators.cleaning import clean_payments, clean_prescribers
from riskloom.operators.rules import RiskThresholds, score
from riskloom.plans.progress import forget, is_finished, remember, stage_key
from riskloom.sources.fingerprints import fingerprint
from riskloom.sources.readers import scan_parquet
from riskloom.sources.sinks import write_table
from riskloom.sources.staging import stage


def prescriber_table(prescribers: DataFrame, payments: DataFrame) -> DataFrame:
    """Clean prescribers with their payment summary, which is written as a stage table right away."""
    return joining.prescriber_level(prescribers, stage(joining.payment_summary(payments), "payment-summary"))


def enrich(level: DataFrame, thresholds: RiskThresholds = RiskThresholds()) -> DataFrame:
    """All engineered columns. The peer means need two columns of ``level`` and are written as a stage table right away."""
    peers = stage(feat.peer_average(level), "peer-average")
    return feat.add_peer_deviation(feat.add_features(level, thresholds), peers)


def score_prescribers(
    prescribers: DataFrame, payments: DataFrame, thresholds: RiskThresholds = RiskThresholds()
) -> DataFrame:
    """Clean tables in, scored prescribers out: 39 columns, one row per prescriber.

    Two stage tables (payment summary, peer means) are written before this returns; the rest is lazy.
    """
    return score(enrich(prescriber_table(prescribers, payments), thresholds), thresholds)


# --- the same job in stages, each leaving Parquet tables that the next one reads -------------


def _path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def _read(spark: SparkSession, folder: str, name: str, stage_name: str) -> DataFrame:
    return scan_parquet(spark, _path(folder, name), stage=stage_name)


def _side_by_side(*jobs: Callable[[], object]) -> None:
    """Run independent jobs together, so that one's last tasks do not leave the cluster idle."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        for running in [pool.submit(job) for job in jobs]:
            running.result()


def clean_stage(raw_prescribers: DataFrame, raw_payments: DataFrame, folder: str) -> None:
    forget(raw_payments.sparkSession, folder, "clean")
    _side_by_side(
        lambda: write_table(clean_prescribers(raw_prescribers), _path(folder, "clean_prescribers")),
        lambda: write_table(clean_payments(raw_payments), _path(folder, "clean_payments")),
    )


def aggregate_stage(spark: SparkSession, folder: str) -> None:
    """Prescriber level and payment level; the merge, by far the largest table, is written alongside."""
    forget(spark, folder, "aggregate")
    prescribers = _read(spark, folder, "clean_prescribers", "aggregate")
    payments = _read(spark, folder, "clean_payments", "aggregate")

    def levels() -> None:
        write_table(joining.payment_summary(payments), _path(folder, "payment_summary"))
        summary = _read(spark, folder, "payment_summary", "aggregate")
        level = joining.prescriber_level(prescribers, summary)
        write_table(level, _path(folder, "prescriber_level"), "prescriber_id")

    _side_by_side(
        levels, lambda: write_table(joining.payment_level(payments, prescribers), _path(folder, "payment_level"))
    )


def feature_stage(spark: SparkSession, folder: str, thresholds: RiskThresholds = RiskThresholds()) -> None:
    forget(spark, folder, "features")
    level = _read(spark, folder, "prescriber_level", "features")
    write_table(feat.peer_average(level), _path(folder, "peer_average"))
    peers = _read(spark, folder, "peer_average", "features")
    enriched = feat.add_peer_deviation(feat.add_features(level, thresholds), peers)
    write_table(enriched, _path(folder, "prescriber_level_enriched"))


def score_stage(spark: SparkSession, folder: str, thresholds: RiskThresholds = RiskThresholds()) -> None:
    forget(spark, folder, "score")
    enriched = _read(spark, folder, "prescriber_level_enriched", "score")
    write_table(score(enriched, thresholds), _path(folder, "scored_prescribers"), "prescriber_id")


# The stages in order, and the tables that each leaves.
STAGE_TABLES = {
    "clean": ["clean_prescribers", "clean_payments"],
    "aggregate": ["payment_summary", "prescriber_level", "payment_level"],
    "features": ["peer_average", "prescriber_level_enriched"],
    "score": ["scored_prescribers"],
}
TABLES = [table for tables in STAGE_TABLES.values() for table in tables]


def resume_etl(
    spark: SparkSession,
    raw_prescribers: DataFrame,
    raw_payments: DataFrame,
    folder: str,
    thresholds: RiskThresholds = RiskThresholds(),
    versions: Sequence[str] | None = None,
) -> list[str]:
    """Run the stages that are not finished for this input; returns their names.

    Once a stage runs, all later ones do. Other raw rows repeat the whole job, other thresholds the
    last two stages. Telling whether the raw tables are the same takes one scan of each, unless
    ``versions`` names them (for instance by the snapshots they were read from).
    """
    work = {
        "clean": lambda: clean_stage(raw_prescribers, raw_payments, folder),
        "aggregate": lambda: aggregate_stage(spark, folder),
        "features": lambda: feature_stage(spark, folder, thresholds),
        "score": lambda: score_stage(spark, folder, thresholds),
    }
    made_from = {"clean": versions or [fingerprint(raw_prescribers), fingerprint(raw_payments)]}
    made_from |= {name: [thresholds] for name in ("features", "score")}
    key, ran = "", []
    for name, tables in STAGE_TABLES.items():
        key = stage_key(name, key, *made_from.get(name, []))
        if ran or not is_finished(spark, folder, name, key, tables):
            work[name]()
            remember(spark, folder, name, key, tables)
            ran.append(name)
    return ran


def run_etl(
    spark: SparkSession,
    raw_prescribers: DataFrame,
    raw_payments: DataFrame,
    folder: str,
    thresholds: RiskThresholds = RiskThresholds(),
    versions: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """All four stages; returns the tables.

    Run again after a failure, it goes on from the last finished stage, as ``resume_etl`` says; a
    lost executor costs the running stage at most. Tables keyed by prescriber are written in key
    order, which gives later reads narrow min/max ranges.
    """
    resume_etl(spark, raw_prescribers, raw_payments, folder, thresholds, versions)
    return {name: _read(spark, folder, name, "etl") for name in TABLES}
