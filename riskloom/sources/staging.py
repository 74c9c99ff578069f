"""Stage tables: intermediate results written to shared storage and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from riskloom.sources.sinks import delete_path

#: Lets Spark delete the shuffle files of a query as soon as it has ended, instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the stage tables written in each open ``passing`` block, the innermost last.
_WRITTEN: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())
#: Where each stage table lies, as long as its frame is held.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without: it gets a folder of its own, once. On a
    cluster a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if configured.startswith("file:") and not context.master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir {configured} is a folder of one machine, not of the cluster")
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-"))
    return context.getCheckpointDir()


def _own_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark).rstrip('/')}/riskloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    The reread table has no lineage to recompute when executors are lost, and its
    file sizes tell the planner whether it is small enough to broadcast; if it is
    not, both join inputs are plain shuffles that skew handling can split. The
    shuffles behind it are not needed any more, and go when it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if written := _WRITTEN.get():
        written[-1].append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    staged = spark.read.schema(df.schema).parquet(path)
    _PATHS[staged] = path
    return staged


def release(*staged: DataFrame) -> None:
    """Delete stage tables, given as ``stage`` returned them, that nothing reads any more."""
    for df in staged:
        delete_path(df.sparkSession, _PATHS[df])


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete the stage tables written inside when the block ends.

    What it gives stages a table that outlives the block, up to the end of the block around it, if any.
    Frames that read deleted tables must not leave the block.
    """
    outer, paths = _WRITTEN.get(), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        inside = _WRITTEN.set(outer)
        try:
            return stage(df, name)
        finally:
            _WRITTEN.reset(inside)

    opened = _WRITTEN.set((*outer, paths))
    try:
        yield keep
    finally:
        _WRITTEN.reset(opened)
        for path in paths:
            delete_path(spark, path)


def drop_stages(spark: SparkSession) -> None:
    """Delete what this application has staged, once its results are written."""
    delete_path(spark, _own_folder(spark))
