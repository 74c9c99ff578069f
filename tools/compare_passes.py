"""Time one-pass operators against the many-pass way of doing the same work.

usage: compare_passes.py [sf_dir]

The many-pass forms are what a straightforward script does: a job per column, per
class or per metric, and single-file CSV tables read with type inference between stages.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.ml.evaluation import MulticlassClassificationEvaluator  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from riskloom.catalog import queries, tables  # noqa: E402
from riskloom.learning import evaluation  # noqa: E402
from riskloom.operators import auditing, cleaning, features, joining, profiling, projecting, rules, sampling  # noqa: E402
from riskloom.plans.etl import run_etl  # noqa: E402
from riskloom.schemas import PRESCRIBER_NUMERIC  # noqa: E402
from riskloom.session import build_session  # noqa: E402
from riskloom.sources import staging  # noqa: E402


def seconds(work, repeats: int = 3) -> float:
    """The best of a few runs."""
    times = []
    for _ in range(repeats):
        start = time.perf_counter()
        work()
        times.append(time.perf_counter() - start)
    return min(times)


def etl_pair(spark, sf_dir):
    raw_people = staging.stage(tables.raw_prescribers(spark, sf_dir), "raw-prescribers")
    raw_paid = staging.stage(tables.raw_payments(spark, sf_dir), "raw-payments")

    def through_csv(df, order_by=None):
        path = staging.new_path(spark, "csv")
        df = df.orderBy(order_by) if order_by else df
        df.coalesce(1).write.option("header", True).csv(path)
        return spark.read.csv(path, header=True, inferSchema=True)

    def many():
        people = through_csv(cleaning.clean_prescribers(raw_people))
        paid = through_csv(cleaning.clean_payments(raw_paid))
        level = through_csv(joining.prescriber_level(people, joining.payment_summary(paid)), "prescriber_id")
        through_csv(joining.payment_level(paid, people))
        enriched = features.add_peer_deviation(
            features.add_features(level, tables.THRESHOLDS), features.peer_average(level)
        )
        through_csv(rules.score(through_csv(enriched, "prescriber_id"), tables.THRESHOLDS), "prescriber_id")

    def one():
        run_etl(spark, raw_people, raw_paid, staging.new_path(spark, "etl"), tables.THRESHOLDS)

    return one, many


def distinct_pair(spark, sf_dir):
    merged = queries._merged(spark, sf_dir)
    return (
        lambda: profiling.distinct_counts(merged).collect(),
        lambda: [merged.select(c).distinct().count() for c in merged.columns],
    )


def audit_pair(spark, sf_dir):
    text = staging.stage(projecting.project_prescribers(tables.raw_prescribers_text(spark, sf_dir)), "text")
    left = auditing.NUMBER_CHARACTERS
    return (
        lambda: auditing.audit_residual_chars(text, PRESCRIBER_NUMERIC).collect(),
        lambda: [text.filter(F.regexp_replace(c, left, "") != "").count() for c in PRESCRIBER_NUMERIC],
    )


def metrics_pair(spark, sf_dir):
    df = staging.stage(tables.surrogate_predictions(spark, sf_dir), "predictions").withColumn(
        "prediction", F.col("prediction").cast("double")
    )
    y, p = F.col("fraud_label"), F.col("prediction")

    def many():
        for name in ("accuracy", "f1"):
            MulticlassClassificationEvaluator(
                labelCol="fraud_label", predictionCol="prediction", metricName=name
            ).evaluate(df)
        for k in sampling.CLASSES:
            for which in ((y == k) & (p == k), (y != k) & (p == k), (y == k) & (p != k)):
                df.filter(which).count()

    return lambda: evaluation.classification_report(df, "fraud_label", "prediction").collect(), many


def resample_pair(spark, sf_dir):
    labels = staging.stage(queries._labels(spark, sf_dir), "labels")

    def write(df):
        df.write.format("noop").mode("overwrite").save()

    return (
        lambda: write(sampling.resample_hash(labels, "fraud_label", "prescriber_id")),
        lambda: write(sampling.resample_random(labels, "fraud_label")),
    )


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(
        "compare",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    pairs = {
        "whole ETL, tables written": etl_pair,
        "distinct values of 34 columns": distinct_pair,
        "leftover characters in 13 columns": audit_pair,
        "all metrics of one model": metrics_pair,
        "class balancing": resample_pair,
    }
    print(f"{'work':36} {'here':>8} {'many-pass':>10}   seconds, {sf_dir}")
    for name, pair in pairs.items():
        one, many = pair(spark, sf_dir)
        print(f"{name:36} {seconds(one):8.2f} {seconds(many):10.2f}", flush=True)
    staging.drop_stages(spark)
    spark.stop()


if __name__ == "__main__":
    main()
