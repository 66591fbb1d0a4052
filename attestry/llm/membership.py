"""A fixed-size Bloom filter: keeps rows out of a shuffle, never decides a result.

The filter's bits are set by a Spark job and its size has a bound that does not grow with the
data (2**max_bits bits).  With more keys than it was sized for it only lets more rows pass, so
every use is followed by the exact join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BITS = 26  # 8 MB


SHIFTS = (34, 40, 46)


class Membership:
    """Which 64-bit hashes may be among the keys.  Keys must be spread evenly over 64 bits.

    Each key owns three bits of one 64-bit word.
    """

    def __init__(self, bits: int, words, count: int):
        self.bits, self._words, self.count = bits, words, count

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """For int64 keys: False only where the key is surely none of the filter's."""
        keys = keys.view(np.uint64)
        words = self._words.value[keys & np.uint64((1 << (self.bits - 6)) - 1)]
        out = np.uint64(1)
        for shift in SHIFTS:
            out = out & (words >> ((keys >> np.uint64(shift)) & np.uint64(63)))
        return out.astype(bool)


def membership(keys: DataFrame, column: str = "key", max_bits: int = MAX_BITS) -> Membership:
    """Build the filter of a bigint column of hashes."""
    spark: SparkSession = keys.sparkSession
    count = keys.count()
    bits = min(max_bits, max(12, int(count * 16).bit_length()))
    word = f"{column} & {(1 << (bits - 6)) - 1}L"
    mask = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({column}, {s}) & 63L as int))" for s in SHIFTS)
    marks = keys.select(F.expr(word).alias("word"), F.expr(mask).alias("mask"))
    words = np.zeros(1 << (bits - 6), np.uint64)
    # at most 2**(max_bits - 6) rows, whatever the number of keys
    rows = marks.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return Membership(bits, spark.sparkContext.broadcast(words), count)


def may_hold_column(filter_: Membership, key: Column) -> Column:
    """The same test as a boolean column."""
    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(filter_.may_hold(keys.fillna(0).to_numpy(np.int64)))

    return test(key)
