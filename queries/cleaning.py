"""Scans, cleaning, ids."""
import uuid

from pyspark.sql import functions as F

from kinsift.operators import cleaning, perturb, reports
from kinsift.session import ensure_checkpoint_dir
from kinsift.sources import delimited
from queries import fixtures as x
from queries.fixtures import q_hit, q_parse_date, q_with
from queries.registry import query

NULLS = "('', 'nan', 'NaN', 'NULL', 'null', 'N/A', 'n/a', 'NA')"
CLEAN_NULLS = "('nan', 'NAN', 'None', '', 'null', 'NULL', '<NA>', 'NA', 'N/A', 'n/a', ' ')"


def _dirty(spark, sf_dir):
    return cleaning.clean_field_names(x.dirty_customer(spark, sf_dir))[0]


def shared_path(spark, name):
    """A new folder next to the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("scan_delimited", """SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size FROM part""")
def scan_delimited(spark, sf_dir):
    path = shared_path(spark, "delimited")
    table = x.load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    delimited.write_delimited(table, path)
    return delimited.read_delimited(spark, path, detect=True)


@query("scan_separator", """SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_type || '|' || p_brand AS p_kind, p_size::VARCHAR AS p_size FROM part""")
def scan_separator(spark, sf_dir):
    """A file whose separator must be named: values hold it too, in quotes."""
    path = shared_path(spark, "piped")
    table = x.load(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat_ws("|", "p_type", "p_brand").alias("p_kind"), "p_size")
    table.write.option("header", True).option("sep", delimited.NAMED_SEPARATORS["Pipe"]).option("escape", '"').csv(path)
    return delimited.read_delimited(spark, path, sep=delimited.NAMED_SEPARATORS["Pipe"])


@query("scan_row_cap", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus FROM orders ORDER BY orders.o_orderkey LIMIT 1000")
def scan_row_cap(spark, sf_dir):
    """The first rows of a file, by the reader's own cap."""
    path = shared_path(spark, "capped")
    orders = x.load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    delimited.write_delimited(orders.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey"), path)
    return delimited.read_delimited(spark, path, rows=1000)


def q_stripped(c):
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@query("normalise_null_tokens", q_with(x.DIRTY) + "SELECT " + ", ".join(
    f"CASE WHEN {q_stripped(c)} NOT IN {NULLS} THEN {q_stripped(c)} END AS {c}" for c in x.DIRTY_COLUMNS) + " FROM dirty")
def normalise_null_tokens(spark, sf_dir):
    return cleaning.normalise_null_tokens(_dirty(spark, sf_dir))


FILLED = [c for c in x.DIRTY_COLUMNS if c != "unused"]


@query("drop_null_columns", q_with(x.DIRTY) + f"SELECT {', '.join(FILLED)} FROM dirty")
def drop_null_columns(spark, sf_dir):
    return cleaning.drop_null_columns(_dirty(spark, sf_dir))


@query("drop_null_rows", q_with(x.DIRTY) + "SELECT * FROM dirty WHERE coalesce(" + ", ".join(x.DIRTY_COLUMNS) + ") IS NOT NULL")
def drop_null_rows(spark, sf_dir):
    return cleaning.drop_null_rows(_dirty(spark, sf_dir))


Q_PRESENT = " + ".join(f"({c} IS NOT NULL)::INT" for c in x.DIRTY_COLUMNS)


@query("sparse_row_filter", q_with(x.DIRTY) + f"SELECT * FROM dirty WHERE {Q_PRESENT} >= 3")
def sparse_row_filter(spark, sf_dir):
    return cleaning.sparse_row_filter(_dirty(spark, sf_dir))


@query("sparse_row_counts", q_with(x.DIRTY) + f"""SELECT count(*) FILTER (n = 0) AS all_null, count(*) FILTER (n = 1) AS n_minus_1_null,
  count(*) FILTER (n = 2) AS n_minus_2_null, count(*) FILTER (n IN (1, 2)) AS partial_null_removed, count(*) FILTER (n >= 3) AS rows_left
  FROM (SELECT {Q_PRESENT} AS n FROM dirty)""")
def sparse_row_counts(spark, sf_dir):
    return cleaning.sparse_row_counts(_dirty(spark, sf_dir))


def q_clean(c):
    text = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN {text} NOT IN {CLEAN_NULLS} THEN {text} END"


@query("clean_text", q_with(x.DIRTY) + "SELECT " + ", ".join(f"{q_clean(c)} AS {c}" for c in x.DIRTY_COLUMNS) + " FROM dirty")
def clean_text(spark, sf_dir):
    return cleaning.clean_text(_dirty(spark, sf_dir))


@query("drop_exact_duplicates", q_with(x.DIRTY) + "SELECT DISTINCT * FROM dirty")
def drop_exact_duplicates(spark, sf_dir):
    return cleaning.drop_exact_duplicates(_dirty(spark, sf_dir))


def q_candidate(column, table):
    text = f"trim({column})"
    return f"""SELECT '{column}' AS "column", avg(CASE WHEN {text} <> '' THEN regexp_matches({text}, '[-/ ]')::INT::DOUBLE END) AS separator_share,
  count({q_parse_date(text)}) AS parsed, coalesce(avg(CASE WHEN {text} <> '' THEN regexp_matches({text}, '[-/ ]')::INT::DOUBLE END) > 0.5, false) AS is_candidate FROM {table}"""


@query("date_candidates", q_with(x.DATES) + q_candidate("order_date", "mixed_dates") + " UNION ALL " + q_candidate("birth_year", "mixed_dates"))
def date_candidates(spark, sf_dir):
    return cleaning.date_candidates(x.mixed_dates(spark, sf_dir))


@query("standardise_dates", q_with(x.DATES) + f"""SELECT unique_id, strftime({q_parse_date('trim(order_date)')}, '%Y-%m-%d') AS order_date,
  birth_year, registr_dt, priority FROM mixed_dates""")
def standardise_dates(spark, sf_dir):
    return cleaning.standardise_dates(x.mixed_dates(spark, sf_dir))[0]


Q_CLEANED = (x.DIRTY + f", kept AS (SELECT {', '.join(q_clean(c) + ' AS ' + c for c in FILLED)} FROM dirty WHERE {Q_PRESENT} >= 3), "
             f"dated AS (SELECT * REPLACE (strftime({q_parse_date('birth_date')}, '%Y-%m-%d') AS birth_date) FROM kept), "
             "cleaned AS (SELECT DISTINCT * FROM dated)")


@query("clean_records", q_with(Q_CLEANED) + "SELECT * FROM cleaned")
def clean_records(spark, sf_dir):
    return cleaning.clean_records(x.dirty_customer(spark, sf_dir)).data


@query("clean_summary", q_with(Q_CLEANED + f", n AS (SELECT {Q_PRESENT} AS n FROM dirty)") + """
SELECT * FROM (VALUES ('field_names', ' Cust ID ', 'cust_id'), ('field_names', 'Cust-Name', 'cust_name'), ('field_names', 'Segment', 'segment'),
  ('field_names', 'Birth Date', 'birth_date'), ('field_names', 'Unused?', 'unused'), ('null_columns_dropped', 'unused', ''),
  ('dates_standardised', 'birth_date', 'YYYY-MM-DD')) t(step, key, value)
UNION ALL SELECT 'null_rows_removed', CASE n WHEN 0 THEN '100%_null' WHEN 1 THEN 'n-1_null' ELSE 'n-2_null' END, count(*)::VARCHAR FROM n WHERE n < 3 GROUP BY n
UNION ALL SELECT 'duplicates_removed', '', ((SELECT count(*) FROM dated) - (SELECT count(*) FROM cleaned))::VARCHAR
UNION ALL SELECT 'summary', 'original_rows', (SELECT count(*) FROM dirty)::VARCHAR
UNION ALL SELECT 'summary', 'rows_removed', ((SELECT count(*) FROM dirty) - (SELECT count(*) FROM cleaned))::VARCHAR
UNION ALL SELECT 'summary', 'final_rows', (SELECT count(*) FROM cleaned)::VARCHAR
UNION ALL SELECT 'summary', 'cols_removed', '1'""")
def clean_summary(spark, sf_dir):
    return cleaning.clean_records(x.dirty_customer(spark, sf_dir)).store().summary()


@query("ensure_unique_id", "SELECT o_orderkey::VARCHAR AS unique_id, o_custkey, o_orderstatus FROM orders")
def ensure_unique_id(spark, sf_dir):
    return cleaning.ensure_unique_id(x.load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")


@query("number_unique_id", "SELECT 'A_' || (row_number() OVER (ORDER BY n_nationkey) - 1)::VARCHAR AS unique_id FROM nation "
       "UNION ALL SELECT 'B_' || (row_number() OVER (ORDER BY c_custkey) - 1)::VARCHAR FROM customer")
def number_unique_id(spark, sf_dir):
    a = cleaning.ensure_unique_id(x.load(spark, sf_dir, "nation").select("n_name"), prefix="A")
    b = cleaning.ensure_unique_id(x.load(spark, sf_dir, "customer").select("c_name"), prefix="B")
    return a.select("unique_id").union(b.select("unique_id"))


@query("stable_unique_id", """SELECT c_name, c_nationkey, c_mktsegment,
  'A_' || md5(c_name || chr(31) || c_nationkey::VARCHAR || chr(31) || c_mktsegment) AS unique_id FROM customer""")
def stable_unique_id(spark, sf_dir):
    return cleaning.stable_unique_id(x.load(spark, sf_dir, "customer").select("c_name", "c_nationkey", "c_mktsegment"))


@query("assign_ground_truth", f"""WITH src AS (SELECT c_custkey::VARCHAR AS id FROM customer)
SELECT id AS unique_id, id AS cluster, 'A' AS source_dataset FROM src
UNION ALL SELECT id || CASE WHEN {x.q_hit(0.5, 'marked', 'id')} THEN '_B_B' ELSE '_B' END, id, 'B' FROM src""")
def assign_ground_truth(spark, sf_dir):
    ids = x.load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("unique_id"))
    marked = F.when(x.hit(0.5, "marked", F.col("unique_id")), F.concat("unique_id", F.lit("_B"))).otherwise(F.col("unique_id"))
    a, b = cleaning.assign_ground_truth(ids, ids.withColumn("unique_id", marked))
    return a.unionByName(b)


@query("align_union", q_with(x.LINK) + """SELECT unique_id, source_dataset, name, nation FROM (SELECT unique_id, source_dataset, name, nation FROM link_a
  UNION ALL SELECT unique_id, source_dataset, name, nation FROM link_b)""")
def align_union(spark, sf_dir):
    a = x.link_a(spark, sf_dir).drop("cluster").withColumn("only_a", F.lit(1))
    b = x.link_b(spark, sf_dir).select("nation", "name", "source_dataset", "unique_id")
    return cleaning.align_union(a.drop("band"), b)


@query("map_codes", q_with(x.PERSON) + """, labels AS (SELECT unique_id, CASE gender WHEN 'M' THEN 'mostly_male' WHEN 'F' THEN 'female' ELSE NULL END AS label FROM person_records)
SELECT unique_id, CASE WHEN label = 'mostly_male' THEN 'M' WHEN label = 'female' THEN 'F' ELSE 'Unknown' END AS gender FROM labels""".replace(" , labels", ", labels"))
def map_codes(spark, sf_dir):
    label = F.when(F.col("gender") == "M", "mostly_male").when(F.col("gender") == "F", "female")
    return x.person_records(spark, sf_dir).select("unique_id", cleaning.map_codes(label).alias("gender"))
