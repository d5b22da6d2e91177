"""Metrics of a pair table. A table of folded rows is counted by its `_n` (see `blocking.weighed`)."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinsift.fixed_values import UNLINKABLE_GRID
from kinsift.functions.quantiles import probability_strip, weight_strip, weighted_quantiles
from kinsift.functions.numbers import pairs_of, ratio, rounded
from kinsift.operators.blocking import counted as count_of, ends


def n_edges(pairs):
    return pairs.agg(count_of(pairs).alias("n_edges"))


def ids_with_edge(pairs):
    """Distinct ids on either side."""
    return ends(pairs).select(F.col("unique_id").alias("uid")).distinct()


def n_ids_with_edge(pairs):
    return ids_with_edge(pairs).agg(F.count("*").alias("n_unique_ids_with_edge"))


def _by_value(pairs, column):
    """Rows per distinct value; a model yields at most one score per gamma pattern."""
    return pairs.groupBy(column).agg(count_of(pairs).alias("n"))


def exact_sum(value, weight):
    """Sum of value x weight as a decimal: the same in any order of the rows."""
    return F.sum((value.cast("decimal(22,15)") * weight.cast("decimal(16,0)")).cast("decimal(38,15)"))


def match_prob_stats(pairs):
    p = F.col("match_probability")
    counted = _by_value(pairs, "match_probability").where(p.isNotNull())
    sums = counted.agg(exact_sum(p, F.col("n")).cast("double").alias("s"), exact_sum(p * p, F.col("n")).cast("double").alias("ss"),
                       F.min(p).alias("low"), F.max(p).alias("high"), F.sum("n").alias("n"), F.lit(1).alias("_one"))
    median = weighted_quantiles(counted, "match_probability", {"median": 0.5}, probability_strip).withColumn("_one", F.lit(1))
    both = sums.join(F.broadcast(median), "_one")
    mean = F.try_divide(F.col("s"), F.col("n").cast("double"))
    stddev = F.sqrt(F.try_divide(F.greatest(F.col("ss") - F.col("s") * mean, F.lit(0.0)), (F.col("n") - 1).cast("double")))
    return both.select(
        rounded(mean, 4).alias("mean_match_prob"), rounded(F.col("median"), 4).alias("median_match_prob"),
        rounded(F.col("low"), 4).alias("min_match_prob"), rounded(F.col("high"), 4).alias("max_match_prob"),
        rounded(stddev, 4).alias("stddev_match_prob"))


def match_prob_hist(pairs):
    """Histogram in bins of 0.05."""
    bin_ = rounded(F.floor(F.col("match_probability") / F.lit(0.05)) * F.lit(0.05), 2)
    return pairs.groupBy(bin_.alias("prob_bin")).agg(count_of(pairs).alias("n_edges")).orderBy("prob_bin")


def match_weight_hist(pairs):
    """Histogram of weights rounded to 0.1."""
    return (pairs.groupBy(rounded(F.col("match_weight"), 1).alias("weight_bin"))
            .agg(count_of(pairs).alias("n_edges")).orderBy("weight_bin"))


def weight_percentiles(pairs):
    wanted = weighted_quantiles(_by_value(pairs, "match_weight"), "match_weight", {f"p{p}": p / 100 for p in (10, 25, 75, 90)}, weight_strip)
    return wanted.select(*[rounded(F.col(f"p{p}"), 4).alias(f"p{p}") for p in (10, 25, 75, 90)])


def gamma_columns(pairs):
    return [c for c in pairs.columns if c.startswith("gamma_")]


def gamma_means(pairs, columns=None):
    """Mean gamma per comparison; null levels count as -1."""
    columns = columns or gamma_columns(pairs)
    if not columns:
        return pairs.sparkSession.createDataFrame([], "comparison string, mean_gamma double")
    mean = (lambda c: F.avg(c)) if "_n" not in pairs.columns else lambda c: ratio(F.sum(F.col(c) * F.col("_n")), F.sum(F.when(F.col(c).isNotNull(), F.col("_n"))))
    row = pairs.agg(*[mean(c).alias(c) for c in columns])
    cells = [F.struct(F.lit(c).alias("comparison"), rounded(F.col(c), 4).alias("mean_gamma")) for c in columns]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def blocking_counts(pairs):
    """Pairs per rule index of a pair table."""
    return pairs.groupBy(F.col("match_key").alias("rule_index")).agg(count_of(pairs).alias("n"))


def unlinkables(pairs, n_records, left_only=False):
    """Share of records without an edge at or above each weight threshold.

    One pass: each id's best weight falls into a grid step, then a running total from the top.
    """
    low, high, width = UNLINKABLE_GRID
    steps = int((high - low) / width)
    sides = ends(pairs, "match_weight", sides="l" if left_only else "lr")
    best = sides.groupBy(F.col("unique_id").alias("uid")).agg(F.max("match_weight").alias("w"))
    step = F.least(F.floor((F.col("w") - F.lit(low)) / F.lit(width)), F.lit(steps))
    counted = best.select(step.alias("step")).groupBy("step").agg(F.count("*").alias("n")).where("step >= 0")
    grid = pairs.sparkSession.range(steps + 1).withColumnRenamed("id", "step").join(counted, "step", "left")
    above = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    linked = grid.select("step", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("linked"), F.lit(1).alias("_one"))
    total = n_records.select(F.col(n_records.columns[0]).alias("total"), F.lit(1).alias("_one"))
    share = F.greatest((F.col("total") - F.col("linked")) / F.col("total") * F.lit(100.0), F.lit(0.0))
    return linked.join(F.broadcast(total), "_one").select(
        (F.col("step") * F.lit(width) + F.lit(low)).alias("threshold"), rounded(share, 1).alias("unlinkable_pct"))


def linkage_rate(pairs, records):
    """Ids with an edge per distinct record id, in percent."""
    linked = n_ids_with_edge(pairs).withColumn("_one", F.lit(1))
    total = records.select("unique_id").distinct().agg(F.count("*").alias("n_records")).withColumn("_one", F.lit(1))
    rate = F.coalesce(ratio(F.col("n_unique_ids_with_edge") * 100, F.col("n_records")), F.lit(0.0))
    return linked.join(F.broadcast(total), "_one").select(
        "n_unique_ids_with_edge", "n_records", rounded(rate, 2).alias("linkage_rate"))


def reduction_ratio(pairs, records, link=False):
    """Share of all possible pairs that was not proposed; link=True counts cross-source pairs only."""
    found = n_edges(pairs).withColumn("_one", F.lit(1))
    size = records.agg(F.count("*").alias("n"), F.count_if(F.col("source_dataset") == "A").alias("na"))
    every = F.expr("na * (n - na)") if link else pairs_of("n")
    size = size.select(F.greatest(every, F.lit(1)).alias("all_pairs"), F.lit(1).alias("_one"))
    share = F.lit(100.0) * (F.lit(1.0) - F.col("n_edges") / F.col("all_pairs"))
    return found.join(F.broadcast(size), "_one").select("n_edges", "all_pairs", rounded(share, 2).alias("reduction_ratio"))
