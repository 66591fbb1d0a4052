"""Carrying a table's own columns through an operator, whatever their names are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def boxed(table: DataFrame) -> Column:
    """All columns of a table as one struct `row`, so none can clash with an operator's own."""
    return F.struct(*[table[c] for c in table.columns]).alias("row")


def unboxed(rows: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The columns in `row` and the added ones, which replace columns of the same name."""
    new = {name.lower() for name in added}
    own = [F.col("row")[c].alias(c) for c in columns if c.lower() not in new]
    return rows.select(*own, *[value.alias(name) for name, value in added.items()])


def free_name(table: DataFrame, name: str) -> str:
    """`name`, made longer until the table has no such column."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


BATCH_ROWS = 500


def bounded_batches(spark: SparkSession | None = None, rows: int = BATCH_ROWS) -> None:
    """Let Python workers get at most so many rows at once, in this session from now on.

    Rows are whole texts here; the default of 10,000 would hold tens of megabytes several times
    over in every worker and in the JVM's buffers.
    """
    spark = spark or SparkSession.getActiveSession()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
