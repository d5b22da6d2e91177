"""Column profiles, inferred types and suggestions."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinsift.fixed_values import (AGREEMENT_SHARE, BOOKKEEPING, SELECT_PRIORITY, SELECTIVE_COLUMNS, SELECTIVE_TYPES,
                                  SUGGESTED_BLOCKING_TYPES, SUGGESTED_COMPARATOR, TYPE_RULES)
from kinsift.operators.blocking import join_keys
from kinsift.functions.numbers import rounded

YEAR = r"^(18|19|20)\d{2}$"


def infer_type(column, id_col=None):
    if column in ("unique_id", id_col):
        return "id"
    return next((kind for kind, marks in TYPE_RULES if any(mark in column for mark in marks)), "text")


def infer_types(columns, id_col=None):
    return {c: infer_type(c, id_col) for c in columns}


def suggest_comparators(types):
    return {c: SUGGESTED_COMPARATOR.get(t, "ExactMatch") for c, t in types.items() if t != "id"}


def suggest_blocking(types):
    return {c: t in SUGGESTED_BLOCKING_TYPES for c, t in types.items()}


def auto_select_fields(types, columns, max_fields=12):
    """Comparison fields, the kinds of text that tell people apart best first, and which of them get a rule of their own."""
    kinds = {c: types.get(c, "text") for c in columns if c not in BOOKKEEPING}
    places = {c: SELECT_PRIORITY.get(kind, SELECT_PRIORITY["text"]) for c, kind in kinds.items()}
    fields = [c for place in sorted(set(places.values())) for c in kinds if places[c] == place][:max_fields]
    on = {c for c, kind in kinds.items() if kind in SELECTIVE_TYPES}.union(SELECTIVE_COLUMNS)
    return fields, {c: c in on for c in fields}


def unpivot(df, columns):
    """(column, value) rows of some columns as text."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def completeness(df, fields):
    """Share of non-null values per field, in percent."""
    fields = [f for f in fields if f in df.columns]
    row = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f)).alias(f) for f in fields])
    share = lambda f: rounded(F.lit(100.0) * F.try_divide(F.col(f).cast("double"), F.col("_n").cast("double")), 1)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), share(f).alias("pct_complete")) for f in fields])).alias("x")).select("x.*")


def column_agreement(df, id_cols=(), minimum=AGREEMENT_SHARE, width=400):
    """Column pairs whose values are equal on more than `minimum` of all rows.

    All pairs are measured in one pass per `width` pairs.
    """
    columns = [c for c in df.columns if c not in id_cols and c not in BOOKKEEPING]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    parts = []
    for start in range(0, len(pairs), width):
        chunk = pairs[start:start + width]
        equal = lambda a, b: F.avg(F.coalesce((F.col(a) == F.col(b)).cast("double"), F.lit(0.0)))
        row = df.agg(*[equal(a, b).alias(f"p{i}") for i, (a, b) in enumerate(chunk)])
        parts.append(row.select(F.explode(F.array(*[
            F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"p{i}").alias("share"))
            for i, (a, b) in enumerate(chunk)])).alias("x")).select("x.*"))
    if not parts:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, share double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("share") > minimum).orderBy(F.desc("share"))


def schema_profile(df, id_col=None, approximate=False):
    """One row per column: inferred type, completeness, distinct values, suggestions.

    Values are counted per (column, value) first, so a frequent value is folded before the shuffle.
    """
    types = infer_types(df.columns, id_col)
    if approximate:
        row = df.agg(F.count("*").alias("_n"), *[F.count(F.col(c)).alias(f"n_{c}") for c in df.columns],
                     *[F.approx_count_distinct(c).alias(f"d_{c}") for c in df.columns])
        counted = row.select("_n", F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n_filled"), F.col(f"d_{c}").alias("n_distinct"))
            for c in df.columns])).alias("x")).select("x.*", F.col("_n").alias("n_rows"))
    else:
        values = unpivot(df, df.columns).groupBy("column", "value").agg(F.count("*").alias("n"))
        counted = values.groupBy("column").agg(
            F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n_filled"),
            F.count("value").alias("n_distinct"))
    fields, toggles = auto_select_fields(types, df.columns)
    facts = df.sparkSession.createDataFrame(
        [(c, i, types[c], suggest_comparators(types).get(c), suggest_blocking(types)[c], c in fields)
         for i, c in enumerate(df.columns)],
        "column string, position int, type string, comparator string, block boolean, selected boolean")
    return counted.join(F.broadcast(facts), "column").select(
        "position", "column", "type", "n_rows", rounded(F.lit(100.0) * F.col("n_filled") / F.col("n_rows"), 1).alias("pct_complete"),
        "n_distinct", "comparator", "block", "selected")


def classify_field_kind(df, fields, parse):
    """year_only, full_date or text per field, by what most of its values look like; years first."""
    rows = unpivot(df, fields).withColumn("value", F.trim("value"))
    filled = F.when(F.col("value") != "", F.col("value"))
    shares = rows.groupBy("column").agg(
        F.avg(filled.rlike(YEAR).cast("double")).alias("year_share"),
        F.avg(F.when(filled.isNotNull(), parse(filled).isNotNull().cast("double"))).alias("date_share"))
    kind = F.when(F.col("year_share") > 0.5, "year_only").when(F.col("date_share") > 0.5, "full_date").otherwise("text")
    return shares.select("column", F.coalesce(kind, F.lit("text")).alias("kind"))


def blocking_diagnostic(a, rules, b=None):
    """Per enabled field: filled values, distinct values, values shared by two or more rows."""
    both = a if b is None else a.unionByName(b, allowMissingColumns=True)
    fields = list(dict.fromkeys(f for keys in join_keys(rules) for f in keys))
    present = [f for f in fields if f in both.columns]
    counts = (unpivot(both, present).where("value is not null and trim(value) <> ''")
              .groupBy("column", "value").agg(F.count("*").alias("n")))
    stats = counts.groupBy("column").agg(
        F.sum("n").alias("non_null_values"), F.count("*").alias("distinct_values"),
        F.count_if(F.col("n") > 1).alias("values_shared_by_2plus_rows"))
    names = both.sparkSession.createDataFrame([(f, f in present) for f in fields], "column string, found boolean")
    issue = (F.when(~F.col("found"), "column not found after cleaning")
             .when(F.coalesce("values_shared_by_2plus_rows", F.lit(0)) == 0, "every value is unique — cannot match"))
    zero = lambda c: F.when(F.col("found"), F.coalesce(c, F.lit(0))).alias(c)
    return names.join(stats, "column", "left").select(
        F.col("column").alias("field"), zero("non_null_values"), zero("distinct_values"),
        zero("values_shared_by_2plus_rows"), issue.alias("issue"))


def dataset_stats(a, b=None):
    """Rows and columns of A, rows of B."""
    rows = a.agg(F.count("*").alias("n_rows_a"), F.lit(len(a.columns)).alias("n_columns_a"), F.lit(1).alias("_one"))
    other = (a if b is None else b).agg((F.lit(0).cast("long") if b is None else F.count("*")).alias("n_rows_b"), F.lit(1).alias("_one"))
    return rows.join(F.broadcast(other), "_one").drop("_one")


def top_categories(df, column, k=10):
    """The k most frequent values of a column."""
    return (df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_records"))
            .orderBy(F.desc("n_records"), "value").limit(k))


def numbered(table, key, value):
    """Position 1..n of each value inside its key, and n, without sorting a whole key in one task.

    A key is cut into 256 parts by a hash of the value; rows are ranked inside a part and the parts
    are offset by their sizes.
    """
    part = F.substring(F.md5(F.col(value)), 1, 2)
    rows = table.select(key, value, part.alias("_part"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_part").orderBy(value)))
    sizes = rows.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    by_part = Window.partitionBy(key).orderBy("_part")
    offsets = sizes.select(key, "_part", (F.sum("_n").over(by_part) - F.col("_n")).alias("_before"),
                           F.sum("_n").over(Window.partitionBy(key)).alias("n_values"))
    return ranked.join(offsets, [key, "_part"]).select(
        key, value, (F.col("_before") + F.col("_rank")).alias("position"), "n_values")
