"""Noisy copies with known truth."""
from pyspark.sql import functions as F

from kinsift.fixed_values import VALID_CODES
from kinsift.operators import cleaning, perturb, profiling
from queries import fixtures as x
from queries import noise_sql as q
from kinsift.functions.draws import SPAN as SPAN_SQL
from queries.fixtures import q_draw, q_hit, q_with
from queries.registry import query

def people(spark, sf_dir):
    return x.person_records(spark, sf_dir)


def one(name, column, change, sql_change, extra=""):
    """A query that shows one field before and after its noise."""
    @query(name, q_with(x.PERSON) + f"SELECT unique_id, {column} AS before, {sql_change} AS after FROM person_records{extra}")
    def run(spark, sf_dir):
        changed = change(F.col(column), F.col("unique_id"))
        return people(spark, sf_dir).select("unique_id", F.col(column).alias("before"), changed.alias("after"))
    return run


@query("hash_sample", q_with(x.PERSON) + f"SELECT unique_id, surname FROM person_records WHERE {q_hit(0.3, 'sample')}")
def hash_sample(spark, sf_dir):
    return perturb.hash_sample(people(spark, sf_dir).select("unique_id", "surname"), 0.3)


one("perturb_typo", "surname", lambda v, key: perturb.typo(v, "t", key), q.q_typo("surname", "t"))
one("perturb_missing", "dob", lambda v, key: perturb.blank(v, 0.05, "m", key), f"CASE WHEN NOT {q_hit(0.05, 'm')} THEN dob END")
one("perturb_email", "email", lambda v, key: perturb.email_variant(v, "e", key), q.q_email_variant("email", "e"))
one("perturb_email_digit", "email", lambda v, key: perturb.email_digit(v, "e", key), q.q_email_digit("email", "e"))
one("perturb_place", "city", lambda v, key: perturb.short_place(v), q.q_short_place("city"))
one("perturb_place_clip", "city", lambda v, key: perturb.clipped_place(v), q.q_clipped_place("city"))
one("perturb_code", "race_code", lambda v, key: perturb.other_code(v, VALID_CODES["race_code"], "c", key), q.q_other_code("race_code", VALID_CODES["race_code"], "c"))
one("perturb_gender", "gender", lambda v, key: perturb.flip_gender(v, "g", key), q.q_flip_gender("gender", "g"))
one("perturb_chars", "surname", lambda v, key: perturb.scramble(v, "h", key), q.q_scramble("surname", "h"))
one("perturb_last_char", "postcode", lambda v, key: perturb.last_char(v, "l", key), q.q_last_char("postcode", "l"))
one("perturb_letters", "email", lambda v, key: perturb.change_letters(v, 2, "w", key), q.q_change_letters("email", 2, "w"))
one("shift_date", "dob", lambda v, key: perturb.shift_date(v), q.q_shift_date("dob"))
one("shift_year", "birth_year", lambda v, key: perturb.shift_year(v, "y", key, 2), q.q_shift_year("birth_year", "y", shift=2))
one("synthetic_code", "city", lambda v, key: perturb.synthetic_code(v, "s", key), q.q_synthetic("city", "s"))
one("assign_weighted", "gender", lambda v, key: perturb.weighted_choice("a", key),
    f"CASE WHEN {q_draw('a')} < {int(round(0.48 * SPAN_SQL))} THEN 'M' WHEN {q_draw('a')} < {int(round(0.96 * SPAN_SQL))} THEN 'F' ELSE 'Unknown' END")

FIELDS = ["unique_id", "first_name", "surname", "dob", "email", "city", "postcode", "gender", "nation"]
TYPES = profiling.infer_types(FIELDS)
RATES = {"first_name": 0.4, "surname": 0.3, "dob": 0.2, "email": 0.5, "city": 0.4, "gender": 0.3, "nation": 0.6}


def _q_rate(c, change):
    return f"CASE WHEN {q_hit(RATES[c], 'rate-' + c)} AND {c} IS NOT NULL THEN {change} ELSE {c} END AS {c}"


@query("derive_b_rates", q_with(x.PERSON) + f"""SELECT unique_id || '_B' AS unique_id, {_q_rate('first_name', q.q_scramble('first_name', 'first_name'))},
  {_q_rate('surname', q.q_scramble('surname', 'surname'))}, {_q_rate('dob', 'NULL')}, {_q_rate('email', q.q_email_digit('email', 'email'))},
  {_q_rate('city', q.q_clipped_place('city'))}, postcode, {_q_rate('gender', q.q_other_gender('gender', 'gender'))}, {_q_rate('nation', q.q_last_char('nation', 'nation'))},
  unique_id AS cluster, 'B' AS source_dataset FROM person_records WHERE {q_hit(0.5, 'sample')}""")
def derive_b_rates(spark, sf_dir):
    return perturb.derive_b_rates(people(spark, sf_dir).select(*FIELDS), TYPES, 0.5, RATES)


CODED = ["unique_id", "first_name", "registr_dt", "birth_year", "gender_code", "party_cd", "nation"]


@query("derive_b_all_rows", q_with(x.PERSON) + f"""SELECT unique_id || '_B' AS unique_id, {q.q_change_letters('first_name', 3, 'first_name')} AS first_name,
  {q.q_shift_date('dob')} AS registr_dt, {q.q_shift_year('birth_year', 'birth_year')} AS birth_year,
  {q.q_other_code('gender_code', VALID_CODES['gender_code'], 'gender_code')} AS gender_code, {q.q_other_code('party_cd', VALID_CODES['party_cd'], 'party_cd')} AS party_cd,
  {q.q_change_letters('nation', 3, 'nation')} AS nation, unique_id AS cluster, 'B' AS source_dataset FROM person_records WHERE {q_hit(0.3, 'sample')}""")
def derive_b_all_rows(spark, sf_dir):
    a = people(spark, sf_dir).withColumn("registr_dt", F.col("dob")).select(*CODED)
    return perturb.derive_b_all_rows(a, profiling.infer_types(CODED), 0.3, letters=3)


@query("derive_b_preset", q_with(x.PERSON) + f"""SELECT unique_id || '_B' AS unique_id, 'B' AS source_dataset, cluster, nation, postcode,
  CASE WHEN {q_hit(0.14, 'rate-first_name')} THEN {q.q_typo('first_name', 'first_name')} ELSE first_name END AS first_name,
  CASE WHEN {q_hit(0.09, 'rate-surname')} THEN {q.q_typo('surname', 'surname')} ELSE surname END AS surname,
  CASE WHEN {q_hit(0.05, 'rate-dob')} THEN NULL ELSE dob END AS dob,
  CASE WHEN {q_hit(0.15, 'rate-email')} THEN {q.q_email_variant('email', 'email')} ELSE email END AS email,
  CASE WHEN {q_hit(0.11, 'rate-city')} THEN {q.q_short_place('city')} ELSE city END AS city,
  CASE WHEN {q_hit(0.07, 'rate-gender')} THEN {q.q_flip_gender('gender', 'gender')} ELSE gender END AS gender
  FROM person_records WHERE {q_hit(0.5, 'sample')}""")
def derive_b_preset(spark, sf_dir):
    return perturb.derive_b_preset(people(spark, sf_dir).select(*FIELDS, "source_dataset", "cluster"), 0.5)


@query("capped_reassign", q_with(x.PERSON) + f""", n AS (SELECT count(*) FILTER (gender = 'Unknown') - floor(0.10 * count(*))::BIGINT AS excess FROM person_records),
ranked AS (SELECT unique_id, gender, first_name, CASE WHEN gender = 'Unknown' AND first_name IS NOT NULL
  THEN row_number() OVER (PARTITION BY gender = 'Unknown' AND first_name IS NOT NULL ORDER BY {q_draw('cap-gender')}, unique_id) END AS pos FROM person_records)
SELECT unique_id, first_name, CASE WHEN pos <= (SELECT excess FROM n) THEN ['M', 'F'][({q_draw('cap-value-gender')} % 2 + 1)::INT] ELSE gender END AS gender FROM ranked""")
def capped_reassign(spark, sf_dir):
    return perturb.capped_reassign(people(spark, sf_dir).select("unique_id", "first_name", "gender"))


@query("noisy_copy", q_with(x.PEOPLE) + "SELECT unique_id, source_dataset, first_name, surname, dob, email, postcode, cluster FROM noisy_people")
def noisy_copy(spark, sf_dir):
    return x.noisy_people(spark, sf_dir).select("unique_id", "source_dataset", "first_name", "surname", "dob", "email", "postcode", "cluster")
