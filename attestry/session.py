"""Session helpers shared by the entry points, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "attestry", cpus: str | None = None) -> SparkSession:
    """A local session for tests and the bench.  On a cluster the caller brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir` where the cluster names one.

    Only a local session (tests, a laptop) may leave it unset and gets a fresh local folder;
    on a cluster executors would write to disks that nobody else reads, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        named = _LOCAL.setdefault(app, "") or tempfile.mkdtemp(prefix="attestry-")
        _LOCAL[app] = named
    return named


_LOCAL: dict[str, str] = {}


def by_merge(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is sorted and merged, and never broadcast.

    For tables with rows for each candidate.  Spark takes a table for as small as its compressed
    files are, and a broadcast table is unpacked in the driver, so its memory would grow with
    the candidates.
    """
    return df.hint("merge")


def cut_lineage(df: DataFrame, reader: SparkSession | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back, in the session `reader` if given.

    What several branches read is computed once; a lost executor re-reads files instead of
    replaying the plan; and the readers still prune columns and know the table's size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    _STAGES.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return (reader or spark).read.schema(df.schema).parquet(path)


_STAGES: dict[str, list[str]] = {}


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_stages(spark: SparkSession) -> None:
    """Remove the tables `cut_lineage` has written in this application.

    For when a job's result is written: what was read from the tables can't be read again.
    """
    _remove(spark, _STAGES.pop(spark.sparkContext.applicationId, []))


@contextmanager
def own_stages(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that `cut_lineage` writes inside, and only these, at the end.

    For a part of a job whose result is written before the end, as a stream's batch is.
    """
    app = spark.sparkContext.applicationId
    outer = _STAGES.pop(app, [])
    try:
        yield
    finally:
        inner = _STAGES.pop(app, [])
        _STAGES[app] = outer
        _remove(spark, inner)
