"""Where queries and their oracle SQL are registered."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from attestry.sources.corpus import spread

QueryFn = Callable[[SparkSession, str], DataFrame]

# what a task takes of a table of short rows; rows of texts are not shuffled for their number alone
SHORT_ROWS = 50_000
TEXTS = ("documents", "pages", "conversations")

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables by attribute: `t.orders`, `t.documents`, …"""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table whose rows are expensive to process, spread over all cores if they lie in few parts."""
        return spread(getattr(self, name), None if name in TEXTS else SHORT_ROWS)


def query(sql: str | None = None, name: str | None = None):
    """Register `fn(tables)` under its own name, with the SQL that must give the same rows."""

    def deco(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or fn.__name__

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return deco
