"""Accuracy against ground truth: labels, confusion matrix, truth space and CRL."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinsift.fixed_values import EPSILON_STEPS
from kinsift.functions.numbers import pairs_of, ratio, rounded
from kinsift.functions.quantiles import probability_strip
from kinsift.operators.blocking import HOT_BLOCK, node, paired, truth_pair_count, truth_pairs


def label_predictions(pairs, records):
    """Pairs plus the true cluster of both sides and whether they agree. A pair table that kept the
    cluster of both sides needs no join."""
    if {"cluster_l", "cluster_r"} <= set(pairs.columns):
        return pairs.withColumn("is_true_match", F.expr("coalesce(cluster_l = cluster_r, false)"))
    truth = records.select("unique_id", "source_dataset", "cluster")
    out = pairs
    for side in "lr":
        keys = [F.col(c).alias(f"{c}_{side}") for c in ("unique_id", "source_dataset")]
        out = out.join(truth.select(*keys, F.col("cluster").alias(f"cluster_{side}")),
                       [f"unique_id_{side}", f"source_dataset_{side}"], "left")
    return out.withColumn("is_true_match", F.coalesce(F.col("cluster_l") == F.col("cluster_r"), F.lit(False)))


def missed_pairs(pairs, records, link=False):
    """Ground-truth pairs that were not predicted."""
    keys = ["unique_id_l", "unique_id_r", "source_dataset_l", "source_dataset_r"]
    return truth_pairs(records, link).join(pairs.select(*keys), keys, "left_anti")


def _block(fields, side=""):
    """Records that a run cannot tell apart: the values of all fields that it looks at, as one text."""
    return F.to_json(F.array(*[F.col(f"{f}{side}").cast("string") for f in fields]))


def missed_blocks(pairs, records, fields, link=False, hot_block=HOT_BLOCK):
    """The misses factorised: (cluster, block_l, block_r, n_missed), block_l <= block_r.

    `fields` are all columns that decide whether a run predicts a pair (those of its rules and of its comparisons). Records of a
    cluster that are alike in them form a block, and a run predicts all pairs of two blocks or none. A cluster thus costs
    its blocks, however many records are in them, and no pair of records is made; `expand_missed` makes them for the blocks one
    wants to see. Ids are taken to be unique.
    """
    sized = records.where(F.col("cluster").isNotNull()).select("cluster", _block(fields).alias("block"), "source_dataset").groupBy("cluster", "block").agg(
        F.count("*").alias("n"), F.count_if(F.col("source_dataset") == "A").alias("na"))
    # A block stands in for its records: tiles keep a cluster of very many blocks apart, as they do for pairs.
    units = sized.select("cluster", F.concat_ws("|", F.col("cluster").cast("string"), "block").alias("unique_id"), F.lit("A").alias("source_dataset"), "block", "n", "na")
    apart = paired(units, None, [["cluster"]], ["cluster", "block", "n", "na"], hot_block).select(
        F.col("cluster_l").alias("cluster"), "block_l", "block_r", F.expr("na_l * (n_r - na_r) + (n_l - na_l) * na_r" if link else "n_l * n_r").alias("n_missed"))
    inside = sized.select("cluster", F.col("block").alias("block_l"), F.col("block").alias("block_r"), (F.expr("na * (n - na)") if link else pairs_of("n")).alias("n_missed"))
    known = pairs.where("cluster_l = cluster_r") if {"cluster_l", "cluster_r"} <= set(pairs.columns) else label_predictions(pairs, records).where("is_true_match")
    sides = [_block(fields, "_l"), _block(fields, "_r")]
    found = known.select(F.col("cluster_l").alias("cluster"), F.least(*sides).alias("block_l"), F.greatest(*sides).alias("block_r")).distinct()
    ordered = apart.select("cluster", F.least("block_l", "block_r").alias("block_l"), F.greatest("block_l", "block_r").alias("block_r"), "n_missed")
    return ordered.unionByName(inside).where("n_missed > 0").join(found, ["cluster", "block_l", "block_r"], "left_anti")


def expand_missed(blocks, records, fields, link=False):
    """The record pairs of missed blocks, ordered as ground-truth pairs are."""
    member = records.select("cluster", _block(fields).alias("block"), "unique_id", "source_dataset", node().alias("node"))
    side = lambda s: member.toDF("cluster", f"block_{s}", f"unique_id_{s}", f"source_dataset_{s}", f"node_{s}")
    both = blocks.join(side("l"), ["cluster", "block_l"]).join(side("r"), ["cluster", "block_r"])
    both = both.where("node_l <> node_r AND (block_l <> block_r OR node_l < node_r)")
    if link:
        both = both.where("source_dataset_l <> source_dataset_r")
    turned = F.col("node_l") > F.col("node_r")
    pick = lambda c, a, b: F.when(turned, F.col(f"{c}_{b}")).otherwise(F.col(f"{c}_{a}"))
    return both.select(*[pick(c, a, b).alias(f"{c}_{a}") for c in ("unique_id", "source_dataset") for a, b in ("lr", "rl")], F.lit(1.0).alias("clerical_match_score"))


def _with_truth_count(counts, records, link):
    total = truth_pair_count(records, link).withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")


def confusion_matrix(pairs, records, link=False, threshold=None):
    """tp, fp, fn and the rates, one row. Every true prediction is a ground-truth pair and pairs are
    unique, so the misses are the truth count minus tp; the truth pairs need not be made."""
    kept = pairs if threshold is None else pairs.where(F.col("match_probability") >= F.lit(float(threshold)))
    if "cluster" not in records.columns:
        blank = ["tp", "fp", "fn", "n_gt_edges", "precision", "recall", "f1", "fdr", "fnr", "fstar"]
        return kept.agg(F.count("*").alias("n_pred_edges")).select(
            "n_pred_edges", *[F.lit(None).cast("double").alias(c) for c in blank], F.lit(True).alias("unavailable"))
    counts = label_predictions(kept, records).agg(
        F.count_if("is_true_match").alias("tp"), F.count_if(~F.col("is_true_match")).alias("fp"))
    return rates(_with_truth_count(counts, records, link))


def rates(counts):
    counts = counts.select("tp", "fp", (F.col("n_gt_edges") - F.col("tp")).alias("fn"), "n_gt_edges",
                           (F.col("tp") + F.col("fp")).alias("n_pred_edges"))
    none = F.lit(0.0)
    counts = counts.select(
        "*", F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), none).alias("_p"),
        F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), none).alias("_r"),
        F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")), none).alias("_s"))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), none)
    # No prediction at all: the recall side is reported as 0 too.
    return counts.select(
        "tp", "fp", "fn", "n_gt_edges", "n_pred_edges", rounded(F.col("_p"), 4).alias("precision"),
        rounded(F.col("_r"), 4).alias("recall"), rounded(f1, 4).alias("f1"),
        rounded(F.lit(1.0) - F.col("_p"), 4).alias("fdr"), rounded(F.lit(1.0) - F.col("_r"), 4).alias("fnr"),
        rounded(F.col("_s"), 4).alias("fstar"))


def truth_space(pairs, records, link=False, strict=False):
    """Counts and rates at every distinct probability, highest first.

    fn counts true pairs predicted at lower probabilities; `strict` adds the true pairs never
    predicted. Unpredicted truth shows up as one last row without a probability. Running totals are
    taken inside strips of probability, on top of the totals of higher strips; the only window
    without a partition runs over the strips.
    """
    grouped = label_predictions(pairs, records).groupBy("match_probability").agg(
        F.count_if("is_true_match").alias("tp1"), F.count_if(~F.col("is_true_match")).alias("fp1"))
    rest = pairs.sparkSession.createDataFrame([(None, 0, 0)], "match_probability double, tp1 long, fp1 long")
    grouped = (grouped.unionByName(rest).groupBy("match_probability").agg(F.sum("tp1").alias("tp1"), F.sum("fp1").alias("fp1"))
               .withColumn("_strip", probability_strip(F.col("match_probability"))))
    strips = grouped.groupBy("_strip").agg(F.sum("tp1").alias("_tp"), F.sum("fp1").alias("_fp"))
    higher = Window.orderBy(F.desc("_strip")).rowsBetween(Window.unboundedPreceding, -1)
    strips = strips.select("_strip", F.coalesce(F.sum("_tp").over(higher), F.lit(0)).alias("_tp"),
                           F.coalesce(F.sum("_fp").over(higher), F.lit(0)).alias("_fp"), F.sum("_tp").over(Window.partitionBy()).alias("tp_all"))
    inside = Window.partitionBy("_strip").orderBy(F.desc("match_probability")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = grouped.join(F.broadcast(strips), "_strip").select(
        "match_probability", (F.col("_tp") + F.sum("tp1").over(inside)).alias("tp"), (F.col("_fp") + F.sum("fp1").over(inside)).alias("fp"),
        "tp_all", (F.col("tp1") + F.col("fp1")).alias("n")).withColumn("fn", F.col("tp_all") - F.col("tp"))
    table = _with_truth_count(table, records, link).withColumn("missed", F.col("n_gt_edges") - F.col("tp_all"))
    if strict:
        table = table.where("match_probability is not null").withColumn("fn", F.col("fn") + F.col("missed"))
    else:
        table = table.where("match_probability is not null or missed > 0 or n > 0")
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return table.select(
        "match_probability", "tp", "fp", "fn", rounded(precision, 6).alias("precision_val"),
        rounded(recall, 6).alias("recall_val"), rounded(F.lit(1.0) - precision, 6).alias("fdr"),
        rounded(F.lit(1.0) - recall, 6).alias("fnr"),
        rounded(ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("fstar"))


#: F* is rounded to six places, so its sum is taken as a whole number of millionths: exact in any order.
MILLION = 1_000_000


def _millionths(column):
    return F.floor(F.col(column) * F.lit(float(MILLION)) + F.lit(0.5)).cast("long")


def _mean_of(total, n):
    return total.cast("double") / (n * F.lit(MILLION)).cast("double")


def crl_score(space, epsilon=0.1, as_coded=False):
    """Mean F* times the width of the probability range where fdr and fnr stay within epsilon."""
    rows = space if as_coded else space.where("match_probability is not null")
    rows = rows.where((F.col("fdr") <= epsilon) & (F.col("fnr") <= epsilon) & F.col("fstar").isNotNull())
    return rows.agg(F.max("match_probability").alias("t_upper"), F.min("match_probability").alias("t_lower"),
                    _mean_of(F.sum(_millionths("fstar")), F.count("fstar")).alias("_mean")).select(
        F.lit(float(epsilon)).alias("epsilon"), "t_upper", "t_lower",
        F.coalesce(F.col("_mean") * (F.col("t_upper") - F.col("t_lower")), F.lit(0.0)).alias("crl_score"))


def crl_curve(space, as_coded=False, steps=EPSILON_STEPS):
    """CRL on an even grid of epsilons. A row of the truth space joins the region at the first grid
    step that reaches its larger error rate, so the curve is a running aggregate over the grid."""
    last = float(steps - 1)
    rows = space if as_coded else space.where("match_probability is not null")
    worst = F.greatest("fdr", "fnr")
    guess = F.ceil(worst * F.lit(last))
    step = (F.when((guess - 1) / F.lit(last) >= worst, guess - 1).when(guess / F.lit(last) < worst, guess + 1)
            .otherwise(guess))
    entering = (rows.where("fdr is not null and fnr is not null and fstar is not null")
                .select(F.greatest(step, F.lit(0)).alias("step"), "fstar", "match_probability")
                .groupBy("step").agg(F.sum(_millionths("fstar")).alias("s"), F.count("*").alias("n"),
                                     F.max("match_probability").alias("hi"), F.min("match_probability").alias("lo")))
    grid = space.sparkSession.range(steps).withColumnRenamed("id", "step").join(entering, "step", "left")
    so_far = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = grid.select("step", F.sum("s").over(so_far).alias("s"), F.sum("n").over(so_far).alias("n"),
                        F.max("hi").over(so_far).alias("hi"), F.min("lo").over(so_far).alias("lo"))
    score = F.coalesce(_mean_of(F.col("s"), F.col("n")) * (F.col("hi") - F.col("lo")), F.lit(0.0))
    return curve.select((F.col("step") / F.lit(last)).alias("epsilon"), score.alias("crl_score"))


def epsilon_z(curve):
    """Smallest epsilon with a score above zero."""
    return curve.where("crl_score > 0").agg(F.min("epsilon").alias("epsilon_z"))


def pr_curve(space):
    """Points of the precision-recall and F* curves."""
    return space.where("match_probability is not null and precision_val is not null and recall_val is not null "
                       "and fstar is not null").select("match_probability", "precision_val", "recall_val", "fstar")
