"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Every query is run to its last row and column; nothing is kept between queries.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from riskloom.catalog.queries import QUERIES
from riskloom.session import build_session
from riskloom.sources.staging import drop_stages

HEADLINE = [
    "scan_payments", "clean_payments", "guard_numeric", "audit_residual_chars", "validate_ranges",
    "payment_aggregates", "prescriber_level", "payment_level", "features", "peer_deviation",
    "scored_prescribers", "risk_distribution", "fired_rules", "rule_hits", "join_predictions",
    "missing_values", "summary_stats", "distinct_counts", "profile_columns", "correlation_matrix",
    "outliers_3sigma", "histogram", "duplicate_rows", "top_states", "top_provider_types",
    "resample_hash", "split_sha", "standardize", "eval_per_class", "classification_report",
    "train_rf", "train_gbt", "probability_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    with contextlib.redirect_stdout(sys.stderr):
        spark = build_session(
            "bench",
            f"local[{cpus}]",
            **{
                "spark.sql.shuffle.partitions": cpus,
                "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                "spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false",
            },
        )
        spark.sparkContext.setLogLevel("ERROR")
        QUERIES["risk_distribution"](spark, sf_dir).collect()  # start the JVM's compilers
        seconds = {}
        for name in sys.argv[1:] or HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        drop_stages(spark)
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
