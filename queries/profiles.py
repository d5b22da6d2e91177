"""Profiles, cohorts and projections over records."""
from pyspark.sql import functions as F

from kinsift.operators import cleaning, cluster_metrics, cohort, profiling
from kinsift.sources import models
from queries import fixtures as x
from queries.cleaning import shared_path
from queries.fixtures import q_parse_date, q_round, q_with
from queries.registry import query

PERSON_COLUMNS = ["unique_id", "first_name", "surname", "dob", "email", "postcode", "city", "gender", "gender_code", "birth_year", "nation"]


def people(spark, sf_dir):
    return x.person_records(spark, sf_dir)


Q_TWINS = x.PERSON + """, twins AS (SELECT first_name, surname, city, gender,
  CASE WHEN gender = 'Unknown' THEN first_name ELSE gender END AS gender_again, nation AS area, nation FROM person_records)"""


def _agreement(a, b):
    return f"SELECT '{a}' AS column_a, '{b}' AS column_b, avg(coalesce(({a} = {b})::INT, 0)::DOUBLE) AS share FROM twins"


_TWIN_COLUMNS = ["first_name", "surname", "city", "gender", "gender_again", "area", "nation"]


@query("column_agreement", q_with(Q_TWINS) + "SELECT * FROM (" + " UNION ALL ".join(
    _agreement(a, b) for i, a in enumerate(_TWIN_COLUMNS) for b in _TWIN_COLUMNS[i + 1:]) + ") WHERE share > 0.5")
def column_agreement(spark, sf_dir):
    again = F.when(F.col("gender") == "Unknown", F.col("first_name")).otherwise(F.col("gender"))
    twins = people(spark, sf_dir).select("first_name", "surname", "city", "gender", again.alias("gender_again"), F.col("nation").alias("area"), "nation")
    return profiling.column_agreement(twins, minimum=0.5)


_FACTS = {   # type, comparator, block, selected: what the names should be taken for
    "unique_id": ("id", None, False, False), "first_name": ("first_name", "JaroWinklerAtThresholds", True, True),
    "surname": ("surname", "JaroAtThresholds", True, True), "dob": ("dob", "DateOfBirthComparison", True, True),
    "email": ("email", "EmailComparison", False, True), "postcode": ("postcode", "PostcodeComparison", True, True),
    "city": ("location", "ExactMatch", True, True), "gender": ("gender", "ExactMatch", False, True),
    "gender_code": ("gender", "ExactMatch", False, True), "birth_year": ("dob", "DateOfBirthComparison", True, True),
    "nation": ("text", "ExactMatch", False, True)}


def _q_profile(i, c):
    kind, comparator, block, selected = _FACTS[c]
    shown = f"'{comparator}'" if comparator else "NULL::VARCHAR"
    return (f"SELECT {i}::INT AS position, '{c}' AS \"column\", '{kind}' AS type, count(*) AS n_rows, "
            f"{q_round(f'100.0::DOUBLE * count({c}) / count(*)', 1)} AS pct_complete, count(DISTINCT {c}) AS n_distinct, "
            f"{shown} AS comparator, {block} AS block, {selected} AS selected FROM person_records")


@query("schema_profile", q_with(x.PERSON) + " UNION ALL ".join(_q_profile(i, c) for i, c in enumerate(PERSON_COLUMNS)))
def schema_profile(spark, sf_dir):
    return profiling.schema_profile(people(spark, sf_dir).select(*PERSON_COLUMNS))


def _q_kind(column, table):
    text = f"trim({column})"
    year = f"avg(CASE WHEN {text} <> '' THEN regexp_matches({text}, '^(18|19|20)[0-9]{{2}}$')::INT END)"
    date = f"avg(CASE WHEN {text} <> '' THEN ({q_parse_date(text)} IS NOT NULL)::INT END)"
    return f"SELECT '{column}' AS \"column\", CASE WHEN {year} > 0.5 THEN 'year_only' WHEN {date} > 0.5 THEN 'full_date' ELSE 'text' END AS kind FROM {table}"


@query("classify_field_kind", q_with(x.DATES) + " UNION ALL ".join(_q_kind(c, "mixed_dates") for c in ("order_date", "birth_year", "registr_dt", "priority")))
def classify_field_kind(spark, sf_dir):
    return profiling.classify_field_kind(x.mixed_dates(spark, sf_dir), ["order_date", "birth_year", "registr_dt", "priority"], cleaning.parse_date)


def _q_diagnose(c):
    return f"""SELECT '{c}' AS field, sum(n)::BIGINT AS non_null_values, count(*) AS distinct_values, count(*) FILTER (n > 1) AS values_shared_by_2plus_rows,
  CASE WHEN count(*) FILTER (n > 1) = 0 THEN 'every value is unique — cannot match' END AS issue
  FROM (SELECT {c}, count(*) AS n FROM link_all WHERE {c} IS NOT NULL AND trim({c}) <> '' GROUP BY {c})"""


@query("blocking_diagnostic", q_with(x.LINK_ALL) + " UNION ALL ".join(_q_diagnose(c) for c in ("name", "nation", "band", "unique_id"))
       + " UNION ALL SELECT 'phone', NULL, NULL, NULL, 'column not found after cleaning'")
def blocking_diagnostic(spark, sf_dir):
    return profiling.blocking_diagnostic(x.link_a(spark, sf_dir), [["name"], ["nation", "band"], ["unique_id"], ["phone"]], x.link_b(spark, sf_dir))


@query("completeness", q_with(x.PERSON) + " UNION ALL ".join(
    f"SELECT '{c}' AS field, {q_round(f'100.0::DOUBLE * count({c}) / count(*)', 1)} AS pct_complete FROM person_records"
    for c in ("first_name", "surname", "dob", "email", "city")))
def completeness(spark, sf_dir):
    return profiling.completeness(people(spark, sf_dir), ["first_name", "surname", "dob", "email", "city", "absent"])


@query("dataset_stats", q_with(x.LINK) + """SELECT (SELECT count(*) FROM link_a) AS n_rows_a, 6::INT AS n_columns_a, (SELECT count(*) FROM link_b) AS n_rows_b""")
def dataset_stats(spark, sf_dir):
    return profiling.dataset_stats(x.link_a(spark, sf_dir), x.link_b(spark, sf_dir))


# ---- cohorts ---------------------------------------------------------------------------------------------------------

FILTERS = {
    "categorical": {"race_code": ["A", "B", "W"], "party_cd": ["DEM", "REP", "UNA"], "gender_code": [], "birth_state": ["NC", "VA"]},
    "ranges": {"birth_year": [1930, 2005], "age_at_year_end": [0, 200]},
    "birth_state_include_missing": True,
}
Q_COHORT = """race_code IN ('A', 'B', 'W') AND party_cd IN ('DEM', 'REP', 'UNA') AND (birth_state IN ('NC', 'VA') OR birth_state IS NULL)
  AND try_cast(birth_year AS DOUBLE) BETWEEN 1930 AND 2005"""
COHORT_COLUMNS = "unique_id, race_code, ethnic_code, party_cd, gender_code, birth_state, birth_year, age_at_year_end"


@query("cohort_filter", q_with(x.PERSON) + f"SELECT {COHORT_COLUMNS} FROM person_records WHERE {Q_COHORT}")
def cohort_filter(spark, sf_dir):
    return cohort.apply_cohort_filters(people(spark, sf_dir), FILTERS).select(*COHORT_COLUMNS.split(", "))


@query("cohort_document", q_with(x.PERSON) + f"SELECT {COHORT_COLUMNS} FROM person_records WHERE {Q_COHORT}")
def cohort_document(spark, sf_dir):
    """The cohort of a definition that was written to a file and read back."""
    path = shared_path(spark, "cohort")
    models.write_text(spark, cohort.filters_to_json(FILTERS, "chosen"), path)
    kept = cohort.filters_from_json(models.read_text(spark, path))
    return cohort.apply_cohort_filters(people(spark, sf_dir), kept).select(*COHORT_COLUMNS.split(", "))


@query("cohort_bounds", q_with(x.PERSON) + " UNION ALL ".join(
    f"SELECT '{c}' AS field, min(try_cast({c} AS DOUBLE))::BIGINT AS lo, max(try_cast({c} AS DOUBLE))::BIGINT AS hi FROM person_records"
    for c in ("birth_year", "age_at_year_end")))
def cohort_bounds(spark, sf_dir):
    return cohort.cohort_bounds(people(spark, sf_dir))


Q_LABELS = """labels(field, code, label) AS (VALUES ('race_code', 'A', 'Asian'), ('race_code', 'B', 'Black or African American'),
  ('race_code', 'I', 'American Indian or Alaska Native'), ('race_code', 'M', 'Two or More Races'), ('race_code', 'O', 'Other'),
  ('race_code', 'P', 'Native Hawaiian or Pacific Islander'), ('race_code', 'U', 'Undesignated'), ('race_code', 'W', 'White'),
  ('ethnic_code', 'HL', 'Hispanic or Latino'), ('ethnic_code', 'NL', 'Not Hispanic or Not Latino'), ('ethnic_code', 'UN', 'Undesignated'),
  ('party_cd', 'DEM', 'Democratic'), ('party_cd', 'REP', 'Republican'), ('party_cd', 'UNA', 'Unaffiliated'), ('party_cd', 'LIB', 'Libertarian'),
  ('party_cd', 'GRE', 'Green'), ('party_cd', 'CST', 'Constitution'), ('gender_code', 'F', 'Female'), ('gender_code', 'M', 'Male'), ('gender_code', 'U', 'Undesignated'))"""


@query("cohort_options", q_with(x.PERSON, Q_LABELS, "codes AS (" + " UNION ".join(
    f"SELECT '{c}' AS field, {c} AS code FROM person_records WHERE {c} IS NOT NULL"
    for c in ("race_code", "ethnic_code", "party_cd", "gender_code", "birth_state")) + ")")
    + "SELECT field, code, coalesce(label, code) AS label FROM codes LEFT JOIN labels USING (field, code)")
def cohort_options(spark, sf_dir):
    return cohort.cohort_options(people(spark, sf_dir))


@query("cohort_count", q_with(x.PERSON) + f"SELECT count(*) FILTER ({Q_COHORT}) AS n_cohort, count(*) AS n_total FROM person_records")
def cohort_count(spark, sf_dir):
    return cohort.cohort_count(people(spark, sf_dir), FILTERS)


@query("top_categories", "SELECT p_name AS value, count(*) AS n_records FROM part GROUP BY 1 ORDER BY n_records DESC, value LIMIT 10")
def top_categories(spark, sf_dir):
    return profiling.top_categories(x.load(spark, sf_dir, "part"), "p_name", 10)


@query("value_breakdown", q_with(x.PERSON) + f"""SELECT city, count(*) AS n_records,
  {q_round('100.0::DOUBLE * count(*) / (sum(count(*)) OVER ())', 1)} AS pct FROM person_records WHERE city IS NOT NULL GROUP BY city""")
def value_breakdown(spark, sf_dir):
    return cluster_metrics.value_breakdown(people(spark, sf_dir), "city")
