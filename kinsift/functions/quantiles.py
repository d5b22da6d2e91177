"""Quantiles of weighted values by running totals over strips of the value range."""
from pyspark.sql import Window
from pyspark.sql import functions as F


def probability_strip(probability):
    """Strip of a sixteenth of a bit of match weight that a probability falls in: at most 2050 strips, in order; null is lowest."""
    odds = F.log2(probability / (1 - probability))
    inside = F.greatest(F.lit(-1024), F.least(F.lit(1024), F.floor(odds * 16)))
    return (F.when(probability.isNull(), -2000).when(probability >= 1, 1024).when(probability <= 0, -1024).otherwise(inside)).cast("int")


def weight_strip(weight):
    """Strip of a sixteenth of a bit of a match weight, at most 4097 strips, in order."""
    return F.greatest(F.lit(-2048), F.least(F.lit(2048), F.floor(weight * 16))).cast("int")


def weighted_quantiles(counted, value, wanted, strip, by=()):
    """One row (per group of `by`): the quantile {name: share} of `value`, each row counting `n` times, interpolated between ranks.

    Totals of the strips say in which strips the ranks lie, and only the rows of those are put in order, so no task or buffer
    holds all values. `strip` maps a value to an int that grows with it. No rows without nulls gives null quantiles.
    """
    rows = counted.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_value"), "n", strip(F.col(value)).alias("_strip"))
    before = Window.partitionBy(*by).orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)
    strips = rows.groupBy(*by, "_strip").agg(F.sum("n").alias("_in")).select(
        *by, "_strip", "_in", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"), F.sum("_in").over(Window.partitionBy(*by)).alias("_all"))
    ranks = []
    for name, share in wanted.items():
        at = (F.col("_all") - 1) * F.lit(float(share))
        for side, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            ranks.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.cast("long").alias("rank"), (at - F.floor(at)).alias("part")))
    # At most two strips for each quantile of a group.
    asked = (strips.select("*", F.explode(F.array(*ranks)).alias("x")).select(*by, "_strip", "_before", "_in", "x.*")
             .where("rank >= _before AND rank < _before + _in"))
    running = Window.partitionBy(*by, "name", "side").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.join(asked, [*by, "_strip"]).withColumn("_upto", F.col("_before") + F.sum("n").over(running)).where("_upto > rank")
    found = met.groupBy(*by, "name", "side").agg(F.min("_value").alias("_value"), F.min("part").alias("part"))
    low, high = (lambda name: F.max(F.when((F.col("name") == name) & (F.col("side") == "low"), F.col("_value"))),
                 lambda name: F.max(F.when((F.col("name") == name) & (F.col("side") == "high"), F.col("_value"))))
    share = lambda name: F.max(F.when(F.col("name") == name, F.col("part")))
    return found.groupBy(*by).agg(*[((1 - share(name)) * low(name) + share(name) * high(name)).alias(name) for name in wanted])
