"""Session settings for the jobs in this package."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: Bytes of input per initial shuffle partition.
PARTITION_BYTES = 128 << 20


def build_session(
    app_name: str = "riskloom", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """Start (or reuse) a session. What is set here and in ``conf`` overrides the cluster's defaults.

    Adaptive execution merges small shuffle partitions and splits skewed ones, but never makes
    more of them when all are large: give ``input_bytes`` (of the largest table) for a job that
    is to start from one partition per ``PARTITION_BYTES`` instead of Spark's default of 200.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        # Recording the Python line of every column call doubles the time a plan takes to build.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if input_bytes:
        count = max(200, -(-input_bytes // PARTITION_BYTES))
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(count)
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
