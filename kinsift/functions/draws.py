"""Reproducible random draws: a 32-bit number hashed from (seed, purpose, record id, k).

The draw depends on the record only, so it is the same under any partitioning and after a
lost task is run again.
"""
from pyspark.sql import functions as F

SPAN = 2 ** 32


def draw(purpose, key, k=0, seed=42):
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), key, F.lit(str(k)) if isinstance(k, int) else k.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hit(rate, purpose, key, seed=42):
    """True on about `rate` of the records."""
    return draw(purpose, key, 0, seed) < F.lit(int(rate * SPAN))


def pick(options, number):
    """Element of an array column chosen by a draw; null for an empty array."""
    return F.try_element_at(options, (F.pmod(number, F.greatest(F.size(options), F.lit(1))) + 1).cast("int"))


def letter(number, first="a"):
    return F.char(F.lit(ord(first)) + F.pmod(number, F.lit(26)))
