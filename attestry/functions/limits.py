"""Optional limits: None keeps everything, and is the default wherever these are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def first_chars(c: Column | str, n: int | None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c if n is None else F.substring(c, 1, n)


def first_items(c: Column | str, n: int | None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c if n is None else F.slice(c, 1, n)


def first_rows(rows: DataFrame, order: WindowSpec, n: int | None) -> DataFrame:
    """The first n rows of each group; Spark cuts below the shuffle."""
    if n is None:
        return rows
    return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def too_many(c: Column, most: int | None) -> Column:
    return F.lit(False) if most is None else c > most
