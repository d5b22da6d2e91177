"""Demographic breakdowns over records and over pairs."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinsift.fixed_values import BINNED_FIELDS, CODE_LABELS, DEMOGRAPHIC_NAMES
from kinsift.functions.numbers import rounded

CODED = [f for f in DEMOGRAPHIC_NAMES if f not in BINNED_FIELDS and f not in ("gender", "city")]
SIMPLE = ["gender", "city"]


def bin_of(value, field):
    """Bin label of a numeric text by [low, high); null outside all bins or when not a number."""
    edges, names = BINNED_FIELDS[field]
    number = F.expr(f"try_cast({value} as double)")
    out = None
    for low, high, name in zip(edges, edges[1:], names):
        test = (number >= F.lit(float(low))) & (number < F.lit(float(high)))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def bin_position(field, label):
    names = BINNED_FIELDS[field][1]
    return F.array_position(F.array(*[F.lit(n) for n in names]), label).cast("int")


def label_of(field, value):
    """Readable label of a code; the code itself when there is none."""
    out = value
    for known, labels in CODE_LABELS.items():
        table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
        out = F.when(field == known, F.coalesce(F.try_element_at(table, value), value)).otherwise(out)
    return out


def _long(df, fields, value):
    cells = [F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields]
    return df.select(F.explode(F.array(*cells)).alias("x")).select("x.field", "x.value")


def _shares(counts):
    total = counts.groupBy("field").agg(F.sum("n_records").alias("_total"))     # one row per field
    share = F.lit(100.0) * F.col("n_records") / F.col("_total")
    return counts.join(F.broadcast(total), "field").select("field", "value", "label", "n_records", rounded(share, 1).alias("pct"))


def coded_breakdown(records, fields=None):
    """Counts and shares of the coded fields that are present, blanks left out."""
    fields = [f for f in (fields or CODED) if f in records.columns]
    rows = _long(records, fields, lambda f: F.col(f).cast("string")).where("value is not null and trim(value) <> ''")
    counts = rows.groupBy("field", "value").agg(F.count("*").alias("n_records"))
    return _shares(counts.withColumn("label", label_of(F.col("field"), F.col("value"))))


def binned_breakdown(records, fields=None):
    """Counts and shares per bin of the numeric fields that are present, empty bins left out."""
    fields = [f for f in (fields or list(BINNED_FIELDS)) if f in records.columns]
    rows = _long(records, fields, lambda f: bin_of(f, f)).where("value is not null")
    counts = rows.groupBy("field", "value").agg(F.count("*").alias("n_records"))
    return _shares(counts.withColumn("label", F.col("value")))


def demographic_snapshot(records):
    """All demographic fields of a record table in one long table."""
    coded = [f for f in CODED + SIMPLE if f in records.columns]
    binned = [f for f in BINNED_FIELDS if f in records.columns]
    cells = [(f, F.col(f).cast("string")) for f in coded] + [(f, bin_of(f, f)) for f in binned]
    table = dict(cells)
    rows = _long(records, list(table), lambda f: table[f]).where("value is not null and trim(value) <> ''")
    counts = rows.groupBy("field", "value").agg(F.count("*").alias("n_records"))
    return _shares(counts.withColumn("label", label_of(F.col("field"), F.col("value"))))


def edge_quality(pairs, fields, threshold=0.8):
    """Per category of the left record: pairs, mean probability, share at or above the threshold."""
    fields = [f for f in fields if f"{f}_l" in pairs.columns]

    def category(f):
        return bin_of(f"{f}_l", f) if f in BINNED_FIELDS else F.trim(F.col(f"{f}_l").cast("string"))

    cells = [F.struct(F.lit(f).alias("field"), category(f).alias("category")) for f in fields]
    rows = (pairs.select(F.explode(F.array(*cells)).alias("x"), "match_probability")
            .select("x.field", "x.category", "match_probability")
            .where("category is not null and category <> '' and lower(category) not in ('nan', 'none')"))
    above = F.avg((F.col("match_probability") >= F.lit(float(threshold))).cast("double"))
    grouped = rows.groupBy("field", "category").agg(
        F.count("match_probability").alias("n_edges"), rounded(F.avg("match_probability"), 3).alias("avg_match_probability"),
        rounded(above * F.lit(100.0), 1).alias("pct_above_threshold"))
    return grouped.withColumn("label", label_of(F.col("field"), F.col("category")))


def top_per_field(snapshot, k=3):
    """The k most frequent values of every field."""
    order = Window.partitionBy("field").orderBy(F.desc("n_records"), "value")
    return snapshot.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def comparison_fields(baseline, current):
    """Known demographic fields compared in both runs, in the first only, in the second only."""
    known = set(DEMOGRAPHIC_NAMES)
    first, second = set(baseline or []) & known, set(current or []) & known
    return sorted(first & second), sorted(first - second), sorted(second - first)


def demographic_shift(before, after):
    """Share of every label in two snapshots, and the difference."""
    old = before.select("field", "label", F.col("pct").alias("pct_before"))
    new = after.select("field", "label", F.col("pct").alias("pct_after"))
    state = (F.when(F.col("pct_before").isNull(), "new").when(F.col("pct_after").isNull(), "dropped").otherwise("shared"))
    delta = rounded(F.col("pct_after") - F.col("pct_before"), 1)
    return old.join(new, ["field", "label"], "full").select(
        "field", "label", "pct_before", "pct_after", state.alias("state"), delta.alias("delta"))


def biggest_shift(shift):
    """The shared label that moved most, per field; ties go to the first label."""
    shared = shift.where("state = 'shared' and delta <> 0")
    best = shared.groupBy("field").agg(F.max(F.abs("delta")).alias("size"))
    return (shared.join(best, "field").where(F.abs("delta") == F.col("size"))
            .groupBy("field").agg(F.min(F.struct("label", "pct_before", "pct_after", "delta")).alias("x"))
            .select("field", "x.*"))


def quality_shift(before, after):
    """Change of match quality per category between two edge_quality tables; a missing side counts as no change."""
    old = before.select("field", "category", F.col("label").alias("label_a"), F.col("n_edges").alias("n_before"),
                        F.col("avg_match_probability").alias("prob_before"))
    new = after.select("field", "category", F.col("label").alias("label_b"), F.col("n_edges").alias("n_after"),
                       F.col("avg_match_probability").alias("prob_after"))
    delta = F.coalesce(rounded(F.col("prob_after") - F.col("prob_before"), 3), F.lit(0.0))
    return old.join(new, ["field", "category"], "full").select(
        "field", "category", F.coalesce("label_a", "label_b").alias("label"),
        F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"),
        "prob_before", "prob_after", delta.alias("prob_delta"))


def biggest_quality_shift(shift):
    moved = shift.where("abs(prob_delta) > 0.001")
    best = moved.groupBy("field").agg(F.max(F.abs("prob_delta")).alias("size"))
    return (moved.join(best, "field").where(F.abs("prob_delta") == F.col("size"))
            .groupBy("field").agg(F.min(F.struct("category", "label", "n_before", "n_after", "prob_delta")).alias("x"))
            .select("field", "x.*"))
