"""Mixing sources to target weights by entropy balancing.

Among all document rates, those nearest to 1 in relative entropy that give every source its target of words are
exponential in a document's size: rate = min(cap, exp(tilt * size / mean size)). The tilt of each source is the root of a convex
dual's gradient, found by Newton steps over the folded table (source, size, number of documents), one aggregation a
step. Rates are then rounded into whole copies along the sizes, so that a source misses its target by less than its
largest document.
"""
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinsift.session import materialise

CYCLE = (3, 1, 2)
OFFSETS = 32  # ways of rounding that are tried for each source
SHARD = 50_000  # documents of one source and size that are ranked together


def source_weights(sources, cycle=CYCLE):
    """`sources` (source, words) with weight: by code point of the source, null last, the cycle repeating.

    The window has no partition: it runs over one row per source, never over documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    return sources.withColumn("weight", F.get(F.array(*[F.lit(float(c)) for c in cycle]), (place - 1) % len(cycle)))


def targets(weighted, growth=1.5, cap=2.0):
    """Target words of each source: `growth` times all words shared by weight, none above `cap` times its own words.

    Sources fill up in the order of cap * words / weight. With the first k full, each other gets weight times (rest of the
    budget / rest of the weights); the right k is the smallest at which the next source stays under its cap. All k are
    tried at once by running sums over the table of sources.
    """
    level = cap * F.col("words") / F.col("weight")
    before = Window.orderBy(level, F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    shared = weighted.withColumns({
        "budget": growth * F.sum("words").over(whole) - cap * F.coalesce(F.sum("words").over(before), F.lit(0)),
        "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "level": level})
    shared = shared.withColumn("share", F.col("budget") / F.col("open"))
    under = F.when(F.col("share") < F.col("level"), F.struct("level", "share"))
    water = F.min(under).over(whole)["share"]
    return shared.select("source", "words", "weight", F.coalesce(F.least(cap * F.col("words"), F.col("weight") * water), cap * F.col("words")).alias("target"))


def _rate(size, mean, tilt, cap):
    """exp(tilt * size / mean), at most cap; a null tilt stands for a source that is taken whole `cap` times."""
    return F.coalesce(F.least(F.lit(cap), F.exp(F.least(tilt * size / mean, F.lit(50.0)))), F.lit(cap))


def _solve(folded, goals, cap, rounds=80, tolerance=1e-9):
    """(source, mean, tilt) by safeguarded Newton steps: lo..hi always holds the root of a growing function.

    Each step is one aggregation over `folded`; what comes back has one row per source. Sums are taken as decimals, so they are the
    same in any order of the rows, and reruns agree to the last copy. A step that would leave the bracket halves it instead. Sources whose target is all they may give need no step.
    """
    exact = lambda column: F.sum(column.cast("decimal(38,9)")).cast("double")
    full = F.col("target") >= cap * F.col("words")
    state = materialise(goals.select("source", "target", "mean", F.when(~full, F.lit(0.0)).alias("tilt"),
                                     F.lit(-700.0).alias("lo"), F.lit(700.0).alias("hi"), full.alias("done")))
    for _ in range(rounds):
        z = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("tilt") * z, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        rest = state.where("not done").drop("done").withColumnRenamed("source", "goal_source")
        at = (folded.join(rest, F.col("source").eqNullSafe(F.col("goal_source")))
              .groupBy("source", "target", "mean", "tilt", "lo", "hi")
              .agg(exact(words * F.least(F.lit(cap), raw)).alias("got"), exact(F.when(raw < cap, words * raw * z)).alias("slope")))
        miss = F.col("got") - F.col("target")
        lo = F.when(miss < 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(miss > 0, F.col("tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") - miss / F.col("slope")
        done = F.abs(miss) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        new = F.when(done, F.col("tilt")).when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        moved = at.select("source", "target", "mean", new.alias("tilt"), lo.alias("lo"), hi.alias("hi"), done.alias("done"))
        state = materialise(state.where("done").unionByName(moved))
        if state.where("not done").isEmpty():
            break
    return state.select(F.col("source").alias("goal_source"), "mean", "tilt")


def mix(documents, source="source", size="size", doc_id="doc_id", growth=1.5, cap=2, cycle=CYCLE):
    """`documents` with source_size, weight, target, rate and copies.

    `size` is a column of words, zero or more; rows are told apart by `doc_id` only for choosing who gets a copy more. copies is
    rate rounded down or up, never above `cap`, the same on every run. Each source's copies * size sum to its target within
    its largest size. Rows with size 0 take nothing; a null source is a source of its own, last in order; an empty table
    gives an empty result; repeated rows are separate documents; columns named like an added one are replaced.
    """
    added = ("source_size", "weight", "target", "rate", "copies")
    docs = documents.drop(*added)
    narrow = docs.select(F.col(source).alias("source"), F.col(size).cast("long").alias("size"))
    folded = materialise(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sums = folded.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("documents"))
    goals = materialise(targets(source_weights(sums, cycle), growth, float(cap))
                        .join(sums.select(F.col("source").alias("s"), "documents"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
                        .withColumn("mean", F.greatest(F.col("words") / F.col("documents"), F.lit(1e-9))))
    tilts = _solve(folded, goals, float(cap))

    known = goals.select(F.col("source").alias("goal_source"), "words", "weight", "target")
    grouped = (folded.join(known.join(tilts.withColumnRenamed("goal_source", "tilt_source"), F.col("goal_source").eqNullSafe(F.col("tilt_source"))),
                           F.col("source").eqNullSafe(F.col("goal_source")))
               .withColumn("rate", _rate(F.col("size"), F.col("mean"), F.col("tilt"), float(cap))))
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = grouped.withColumn("end", F.sum(F.col("n") * F.col("rate")).over(along)).withColumn("start", F.col("end") - F.col("n") * F.col("rate"))

    def rounded(offset):
        """Copies of a group: the running sum of rates, rounded down after a shift, grows by so much along the group."""
        grown = F.floor(F.col("end") + offset) - F.floor(F.col("start") + offset)
        return F.least(F.greatest(grown, F.col("n") * F.floor("rate")), F.col("n") * F.ceil("rate"))

    grouped = materialise(grouped.select("source", "size", "n", "words", "weight", "target", "rate", "start", "end"))
    tries = [(k + 0.5) / OFFSETS for k in range(OFFSETS)]
    errors = grouped.groupBy("source", "target").agg(*[F.sum(rounded(F.lit(u)) * F.col("size")).alias(f"t{k}") for k, u in enumerate(tries)])
    ranked = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("miss"), F.lit(u).alias("offset")) for k, u in enumerate(tries)]))
    chosen = errors.select(F.col("source").alias("offset_source"), ranked["offset"].alias("offset"))
    plan = (grouped.join(chosen, F.col("source").eqNullSafe(F.col("offset_source")))
            .select(F.col("source").alias("plan_source"), F.col("size").alias("plan_size"), "n", "words", "weight", "target", "rate",
                    rounded(F.col("offset")).alias("group_copies")))

    # A group's copies go round its documents; the remainder goes to the first by hash. Large groups are ranked in shards.
    spread = F.xxhash64(F.col(doc_id).cast("string"))
    carried = (docs.withColumn("plan_key", spread).join(plan, F.col(source).eqNullSafe(F.col("plan_source")) & (F.col(size).cast("long") == F.col("plan_size")))
               .withColumn("shard", F.pmod(F.shiftright("plan_key", 20), F.ceil(F.col("n") / F.lit(SHARD)))))
    counts = carried.groupBy("plan_source", "plan_size", "n", "group_copies", "shard").agg(F.count(F.lit(1)).alias("shard_n"))
    over = Window.partitionBy("plan_source", "plan_size").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("seen", F.sum("shard_n").over(over)).select(
        F.col("plan_source").alias("c_source"), F.col("plan_size").alias("c_size"), F.col("shard").alias("c_shard"),
        (F.expr("seen * (group_copies % n) div n") - F.expr("(seen - shard_n) * (group_copies % n) div n")).alias("shard_extra"))
    within = Window.partitionBy("plan_source", "plan_size", "shard").orderBy("plan_key", F.col(doc_id))
    out = (carried.join(counts, F.col("plan_source").eqNullSafe(F.col("c_source")) & (F.col("plan_size") == F.col("c_size")) & (F.col("shard") == F.col("c_shard")))
           .withColumn("place", F.row_number().over(within))
           .withColumn("copies", (F.expr("group_copies div n") + F.when(F.col("place") <= F.col("shard_extra"), 1).otherwise(0)).cast("long")))
    return out.select(*docs.columns, F.col("words").alias("source_size"), "weight", "target", "rate", "copies")
