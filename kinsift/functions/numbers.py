"""Numeric helpers that give the same bits on every engine."""
from pyspark.sql import functions as F


def rounded(value, digits):
    """Round half up through floor."""
    scale = float(10 ** digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(top, bottom):
    """Double division, null on a zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def pairs_of(n):
    """Number of unordered pairs among n records."""
    return F.expr(f"({n} * ({n} - 1)) div 2")
