"""Cleaning: names, null handling, text, dates, duplicates, ids."""
import re
from functools import cached_property

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinsift.fixed_values import BOOKKEEPING, CLEAN_NULL_TOKENS, DETECTED_GENDER, LOAD_NULL_TOKENS
from kinsift.operators.profiling import infer_types
from kinsift.session import materialise

# Date formats tried in this order.
DATE_FORMATS = ["yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "yyyyMMdd"]
# What makes a column name look like a date.
DATE_NAMES = ["date", "dob", "birth"]


def clean_name(name):
    return re.sub("_+", "_", re.sub("[^a-z0-9_]", "_", str(name).strip().lower())).strip("_")


def clean_field_names(df):
    """Lower-case alphanumeric column names, made unique with _2, _3…; returns the names that changed."""
    names, changed = [], {}
    for old in df.columns:
        base = new = clean_name(old)
        n = 1
        while new in names:
            n += 1
            new = f"{base}_{n}"
        names.append(new)
        if new != old:
            changed[old] = new
    return df.toDF(*names), changed


def normalise_null_tokens(df):
    """Trim every text column and turn blank or missing markers into null."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, StringType):
            text = F.regexp_replace(F.col(f.name), r"(?U)^\s+|\s+$", "")
            out.append(F.when(~text.isin(LOAD_NULL_TOKENS), text).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def null_columns(df):
    """Columns without any value, from one pass."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if counts[c] == 0]


def drop_null_columns(df):
    return df.drop(*null_columns(df))


def drop_null_rows(df):
    return df.dropna("all")


def values_present(df):
    total = F.lit(0)
    for c in df.columns:
        total = total + F.col(c).isNotNull().cast("int")
    return total


def values_needed(df, as_coded=False):
    """Values that a row must have to stay."""
    return 3 if as_coded else min(3, len(df.columns))


def sparse_row_filter(df, as_coded=False):
    """Keep rows with at least three values, or all values of a narrower table; `as_coded` asks for three of any table."""
    return df.where(values_present(df) >= values_needed(df, as_coded))


def sparse_row_counts(df):
    """How many rows each pass of the null filter drops."""
    n = values_present(df)
    return df.agg(F.count_if(n == 0).alias("all_null"), F.count_if(n == 1).alias("n_minus_1_null"),
                  F.count_if(n == 2).alias("n_minus_2_null"),
                  F.count_if((n == 1) | (n == 2)).alias("partial_null_removed"),
                  F.count_if(n >= 3).alias("rows_left"))


def clean_text(df):
    """Every column as text, blanks collapsed, null tokens to null."""
    out = []
    for c in df.columns:
        text = F.trim(F.regexp_replace(F.col(c).cast("string"), r"(?U)\s+", " "))
        out.append(F.when(~text.isin(CLEAN_NULL_TOKENS), text).alias(c))
    return df.select(*out)


def drop_exact_duplicates(df):
    return df.dropDuplicates()


def parse_date(text, formats=None):
    return F.coalesce(*[F.try_to_date(text, f) for f in (formats or DATE_FORMATS)])


def date_candidates(df):
    """Columns named like dates and how their values look: (column, share with a separator, share that parses)."""
    named = [c for c in df.columns if any(mark in c for mark in DATE_NAMES)]
    if not named:
        return df.sparkSession.createDataFrame([], "column string, separator_share double, parsed long, is_candidate boolean")
    cells = []
    for c in named:
        text = F.trim(F.col(c).cast("string"))
        filled = F.when(text != "", text)
        cells += [F.avg(filled.rlike("[-/ ]").cast("double")).alias(f"s_{c}"), F.count(parse_date(text)).alias(f"p_{c}")]
    row = df.agg(*cells)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"s_{c}").alias("separator_share"), F.col(f"p_{c}").alias("parsed"),
                 F.coalesce(F.col(f"s_{c}") > 0.5, F.lit(False)).alias("is_candidate")) for c in named])).alias("x")).select("x.*")


def standardise_dates(df, columns=None):
    """Write candidate date columns as yyyy-MM-dd; a column where nothing parses stays as it is.
    Returns the table and the columns rewritten."""
    if columns is None:
        # one row per date-named column
        columns = [r["column"] for r in date_candidates(df).where("is_candidate and parsed > 0").collect()]
    done = {c: "YYYY-MM-DD" for c in columns}
    out = [F.date_format(parse_date(F.trim(F.col(c))), "yyyy-MM-dd").alias(c) if c in done else F.col(c) for c in df.columns]
    return df.select(*out), done


class CleanResult:
    """A cleaned table, the inferred types, and a log that is counted only when asked for."""

    def __init__(self, data, types, facts):
        self.data, self.types, self._facts, self._final = data, types, facts, None

    def store(self):
        """Write the cleaned table once to the shared folder; its rows are counted while they are written. `data` then reads what was
        written, and the log needs no pass of its own."""
        seen = Observation()
        self.data = materialise(self.data.observe(seen, F.count(F.lit(1)).alias("rows")))
        self._final = seen.get["rows"]
        return self

    @cached_property
    def log(self):
        rows, kept = self._facts["rows"], self._facts["kept"]
        final = self.data.count() if self._final is None else self._final
        return {
            "field_names": self._facts["renamed"], "null_columns_dropped": self._facts["empty"],
            "null_rows_removed": self._facts["sparse"], "dates_standardised": self._facts["dates"],
            "duplicates_removed": kept - final,
            "summary": {"original_rows": rows, "rows_removed": rows - final, "final_rows": final,
                        "cols_removed": len(self._facts["empty"])},
        }

    def summary(self):
        """The log as (step, key, value) rows."""
        rows = [("field_names", k, v) for k, v in sorted(self.log["field_names"].items())]
        rows += [("null_columns_dropped", c, "") for c in self.log["null_columns_dropped"]]
        rows += [("null_rows_removed", k, str(v)) for k, v in self.log["null_rows_removed"].items()]
        rows += [("dates_standardised", k, v) for k, v in sorted(self.log["dates_standardised"].items())]
        rows.append(("duplicates_removed", "", str(self.log["duplicates_removed"])))
        rows += [("summary", k, str(v)) for k, v in self.log["summary"].items()]
        return self.data.sparkSession.createDataFrame(rows, "step string, key string, value string")


def clean_records(df, id_col=None, prenormalise=False, as_coded=False):
    """The whole cleaning chain in its fixed order. One pass finds the empty columns and sparse rows,
    one the date columns; the cleaned table itself stays lazy. With the log, or stored with it, the input is read three times."""
    df, renamed = clean_field_names(df)
    if prenormalise:
        df = normalise_null_tokens(df)
    n = values_present(df)
    passes = df.agg(
        *[F.count(F.col(c)).alias(f"c_{c}") for c in df.columns], F.count("*").alias("n_rows"),
        *[F.count_if(n == k).alias(f"rows_{k}") for k in (0, 1, 2)]).first()
    empty = [c for c in df.columns if passes[f"c_{c}"] == 0]
    filled = df.drop(*empty)
    need = values_needed(filled, as_coded)
    kept = clean_text(sparse_row_filter(filled, as_coded))
    dated, dates = standardise_dates(kept)
    facts = {"renamed": renamed, "empty": empty, "dates": dates, "rows": passes["n_rows"],
             "kept": passes["n_rows"] - sum(passes[f"rows_{k}"] for k in range(need)),
             "sparse": {"100%_null": passes["rows_0"], "n-1_null": passes["rows_1"], "n-2_null": passes["rows_2"]}}
    unique = drop_exact_duplicates(dated)
    mapped = renamed.get(id_col, id_col) if id_col else None
    return CleanResult(unique, infer_types(unique.columns, mapped), facts)


# ---- ids, sources and truth -----------------------------------------------------------------------

def ensure_unique_id(df, id_col=None, prefix="A"):
    """Use the chosen id column, else number the rows as prefix_0, prefix_1, … in scan order."""
    if id_col and id_col in df.columns and id_col != "unique_id":
        df = df.withColumnRenamed(id_col, "unique_id")
    elif "unique_id" not in df.columns:
        # Row number = rows in earlier partitions + position in this one; only one count per
        # partition is gathered, never the rows. Valid on a plain scan, whose partitions repeat.
        tagged = df.select(F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"), "*")
        counts = tagged.groupBy("_p").count().collect()
        start, table = 0, {}
        for row in sorted(counts, key=lambda r: r["_p"]):
            table[row["_p"]] = start
            start += row["count"]
        offsets = df.sparkSession.createDataFrame(sorted(table.items()), "_p int, _start long")
        number = F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
        df = (tagged.join(F.broadcast(offsets), "_p")
              .withColumn("unique_id", F.concat(F.lit(f"{prefix}_"), number.cast("string"))).drop("_p", "_m", "_start"))
    return df.withColumn("unique_id", F.col("unique_id").cast("string"))


def stable_unique_id(df, prefix="A"):
    """Ids hashed from the whole row: the same in every run and under any partitioning."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u001e")) for c in df.columns])
    return df.withColumn("unique_id", F.concat(F.lit(f"{prefix}_"), F.md5(text)))


def _without_b(uid):
    return F.when(uid.endswith("_B"), F.regexp_replace(uid, "_B$", "")).otherwise(uid)


def suffix_b(uid):
    uid = F.coalesce(uid.cast("string"), F.lit("NA"))
    return F.when(uid.endswith("_B"), uid).otherwise(F.concat(uid, F.lit("_B")))


def suffix_ids(b):
    """The ids of a second table with _B after them, unless all of them end so already. The table decides once, so two
    ids that differ stay different."""
    marked = b.agg(F.coalesce(F.min(F.coalesce(F.col("unique_id").cast("string"), F.lit("NA")).endswith("_B")), F.lit(True)).alias("_marked"), F.lit(1).alias("_one"))
    uid = F.coalesce(F.col("unique_id").cast("string"), F.lit("NA"))
    return (b.withColumn("_one", F.lit(1)).join(F.broadcast(marked), "_one")
            .withColumn("unique_id", F.when(F.col("_marked"), uid).otherwise(F.concat(uid, F.lit("_B")))).drop("_one", "_marked"))


def assign_ground_truth(a, b=None):
    """Source labels, truth clusters (an id of B without its _B suffix) and suffixed ids for B."""
    a = a.withColumn("source_dataset", F.lit("A"))
    if "cluster" not in a.columns:
        a = a.withColumn("cluster", F.col("unique_id"))
    if b is None:
        return a, None
    if "cluster" not in b.columns:
        b = b.withColumn("cluster", _without_b(F.col("unique_id")))
    return a, suffix_ids(b).withColumn("source_dataset", F.lit("B"))


def prepare(df, source):
    """Make sure a record table has text ids and a source label."""
    df = ensure_unique_id(df, prefix=source)
    return df if "source_dataset" in df.columns else df.withColumn("source_dataset", F.lit(source))


def align(a, b):
    """Both tables restricted to their common columns, in A's order."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(*common), b.select(*common)


def align_union(a, b):
    a, b = align(a, b)
    return a.unionByName(b)


def map_codes(value, table=None, default="Unknown"):
    """Look a code up in a fixed map; null or unlisted gives the default."""
    table = table or DETECTED_GENDER
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, value), F.lit(default))


def data_columns(df):
    return [c for c in df.columns if c not in BOOKKEEPING]
