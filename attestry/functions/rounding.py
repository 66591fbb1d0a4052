"""Rounding that depends on the exact binary value of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sums of scores go through this type: decimal addition has no rounding, so the order in which
# partial sums are combined can never show in a result.
EXACT = "decimal(24,6)"

_SPLIT = 134217729.0  # 2**27 + 1


def _halves(c: float) -> tuple[float, float]:
    t = _SPLIT * c
    high = t - (t - c)
    return high, c - high


def exact_sum(x: Column) -> Column:
    """Order-independent sum of values that carry at most six decimals."""
    return F.sum(x.cast(EXACT)).cast("double")


def total(*terms: Column) -> Column:
    """The sum of a few terms without the error of adding doubles one after the other."""
    exact = [t.cast("double").cast("decimal(30,15)") for t in terms]
    out = exact[0]
    for t in exact[1:]:
        out = out + t
    return out.cast("double")


def round_even(x: Column, digits: int) -> Column:
    """Half-to-even on the exact value, so 2.675 (which is a little less) gives 2.67.

    `bround` works on the shortest decimal text and would call that a tie.  Here the error of
    x * 10**digits is recovered exactly from products of half-width factors, and only a product
    without any error is a tie.  Plain arithmetic, so it stays inside generated code.
    """
    scale = 10.0**digits
    ch, cl = _halves(scale)
    x = x.cast("double")
    p = x * scale
    t = x * _SPLIT
    xh = t - (t - x)
    xl = x - xh
    error = xl * cl - (((p - xh * ch) - xl * ch) - xh * cl)
    k = F.floor(p).cast("double")
    rest = p - k
    tie = F.when(error > 0, 1.0).when(error < 0, 0.0).otherwise(F.pmod(k, F.lit(2.0)))
    up = F.when(rest > 0.5, 1.0).when(rest < 0.5, 0.0).otherwise(tie)
    return (k + up) / scale
