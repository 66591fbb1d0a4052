"""A table of reports that grows by whole commits.

A commit is one folder of rows and, once all of them are written, one empty file that names it.
Readers see named folders only, so a half-written commit is never read and a lost driver loses
nothing; nothing that is stored is ever overwritten.  A commit is known by who wrote it and by
that writer's own number (a stream's batch id): the same one again changes nothing.

    path/rows/version=<place>.<writer>.<number>/   rows of one commit
    path/rows/version=<place>.base/                all rows up to that place, merged
    path/commits/<place>.<writer>.<number>         that commit is whole

Versions sort by their place.  What several commits say about one key is settled when it is read
(`current`), and once and for all by `compact`.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version"
BASE = "base"
Merge = Callable[[DataFrame], DataFrame]


def _place(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def committed(spark: SparkSession, path: str) -> list[str]:
    """The versions that are whole, in order of their place."""
    files, folder = _place(spark, f"{path}/commits")
    if not files.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(folder))


def _name(spark: SparkSession, path: str, version: str) -> None:
    files, marker = _place(spark, f"{path}/commits/{version}")
    files.create(marker, False).close()


def commit(rows: DataFrame, path: str, number: int, writer: str = "batch") -> bool:
    """Add the rows as this writer's commit of that number; False if it is already there."""
    if not re.fullmatch(r"[\w-]+", writer) or writer == BASE:
        raise ValueError(f"a writer's name is made of letters, digits, _ and -, and is not {BASE}: {writer!r}")
    spark = rows.sparkSession
    versions = committed(spark, path)
    if any(v.split(".", 1)[1] == f"{writer}.{number}" for v in versions):
        return False
    last = int(versions[-1].split(".")[0]) if versions else -1
    version = f"{last + 1:012d}.{writer}.{number}"
    # what a lost attempt left in this folder was never named
    rows.drop(VERSION).write.mode("overwrite").parquet(f"{path}/rows/{VERSION}={version}")
    _name(spark, path, version)
    return True


def next_number(spark: SparkSession, path: str, writer: str = "batch") -> int:
    """The number after the writer's last commit."""
    own = [v.split(".") for v in committed(spark, path)]
    return max((int(v[2]) for v in own if v[1] == writer), default=-1) + 1


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of all commits with their `version`, from the newest merged state on; None if there are none."""
    versions = committed(spark, path)
    if not versions:
        return None
    bases = [v for v in versions if v.endswith(f".{BASE}")]
    if bases:
        # a base holds every commit before its place
        versions = [bases[-1], *(v for v in versions if v > bases[-1] and not v.endswith(f".{BASE}"))]
    folders = [f"{path}/rows/{VERSION}={v}" for v in versions]
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*folders)
    return rows.withColumn(VERSION, F.col(VERSION).cast("string"))


def newest(keys: list[str], order: list[str] | None = None) -> Merge:
    """Of each key the row that is last by `order`, else by commit."""
    order = order or [VERSION]

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        return last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])

    return merge


def summed(keys: list[str], counts: list[str]) -> Merge:
    """Of each key the sums over all commits."""
    return lambda rows: rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def current(spark: SparkSession, path: str, merge: Merge) -> DataFrame:
    """The table as all commits together say."""
    rows = stored(spark, path)
    if rows is None:
        raise FileNotFoundError(f"no commit in {path}")
    return merge(rows).drop(VERSION)


def compact(spark: SparkSession, path: str, merge: Merge) -> bool:
    """Write the merged state as the store's new base, so that reading takes one folder again.

    The folders it replaces stay for readers that are under way; `vacuum` removes them.
    """
    versions = committed(spark, path)
    if not versions or versions[-1].endswith(f".{BASE}"):
        return False
    base = f"{int(versions[-1].split('.')[0]) + 1:012d}.{BASE}"
    current(spark, path, merge).write.mode("overwrite").parquet(f"{path}/rows/{VERSION}={base}")
    _name(spark, path, base)
    return True


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the rows that a base has replaced; their commits stay known."""
    versions = committed(spark, path)
    bases = [v for v in versions if v.endswith(f".{BASE}")]
    gone = 0
    for version in versions[: versions.index(bases[-1])] if bases else []:
        files, folder = _place(spark, f"{path}/rows/{VERSION}={version}")
        gone += bool(files.delete(folder, True))
    return gone
