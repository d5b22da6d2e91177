"""Record tables derived from the supplied tables, once as DataFrames and once as SQL.

The supplied tables have no people and no nulls, so fields are derived from whole rows and whole
texts, and nulls are put in by a hash of the record id. No row is left out anywhere.
"""
import math

from pyspark.sql import functions as F

from kinsift.functions.draws import draw, hit, pick
from kinsift.functions.numbers import rounded
from kinsift.operators import blocking, scoring
from kinsift.operators.comparators import build_comparisons
from kinsift.operators.components import cluster_records
from kinsift.session import many_tasks, materialise


def load(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- SQL building blocks ---------------------------------------------------------------------------

def q_draw(purpose, key="unique_id", k="'0'", seed=42):
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{purpose}', {key}, {k})), 1, 8))::BIGINT)"


def q_hit(rate, purpose, key="unique_id"):
    return f"({q_draw(purpose, key)} < {int(rate * 2 ** 32)})"


def q_round(expr, digits):
    scale = f"{10 ** digits}::DOUBLE"
    return f"(floor(({expr}) * {scale} + 0.5::DOUBLE) / {scale})"


def q_with(*parts):
    return "WITH " + ", ".join(parts) + " "


# ---- part: pair-heavy records -------------------------------------------------------------------------

def part_records(spark, sf_dir):
    uid = F.col("p_partkey").cast("string")
    return load(spark, sf_dir, "part").select(
        uid.alias("unique_id"), F.lit("A").alias("source_dataset"),
        F.when(~hit(0.03, "name", uid), F.col("p_name")).alias("name"),
        F.when(~hit(0.02, "brand", uid), F.col("p_brand")).alias("brand"),
        F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"),
        F.floor(F.col("p_retailprice") * 100 + 0.5).cast("string").alias("cluster"))


_uid = "p_partkey::VARCHAR"
PART = f"""part_records AS (SELECT {_uid} AS unique_id, 'A' AS source_dataset,
  CASE WHEN NOT {q_hit(0.03, 'name', _uid)} THEN p_name END AS name,
  CASE WHEN NOT {q_hit(0.02, 'brand', _uid)} THEN p_brand END AS brand,
  p_type AS type, p_size::VARCHAR AS size,
  floor(p_retailprice * 100 + 0.5)::BIGINT::VARCHAR AS cluster FROM part)"""

PART_FIELDS = ["name", "brand", "type", "size"]

# ---- documents: the main deduplication fixture, keyed on whole texts ----------------------------------


def doc_records(spark, sf_dir):
    uid = F.col("doc_id").cast("string")
    text = F.col("text")
    count = lambda mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit(""))) + 1).cast("string")
    bare = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return load(spark, sf_dir, "documents").select(
        uid.alias("unique_id"), F.lit("A").alias("source_dataset"), F.md5(text).alias("body"),
        F.col("n_chars").cast("string").alias("n_chars"),
        F.when(~hit(0.03, "words", uid), count(" ")).alias("n_words"), count("\n").alias("n_lines"),
        F.when(~hit(0.04, "lang", uid), F.col("lang")).alias("lang"), F.col("source"), F.md5(bare).alias("cluster"))


def narrow_docs(spark, sf_dir):
    """The derived records written once, so that the texts are read once however often the records are."""
    return materialise(doc_records(spark, sf_dir))


_uid = "doc_id::VARCHAR"
DOC = f"""doc_records AS (SELECT {_uid} AS unique_id, 'A' AS source_dataset, md5(text) AS body,
  n_chars::VARCHAR AS n_chars,
  CASE WHEN NOT {q_hit(0.03, 'words', _uid)} THEN (length(text) - length(replace(text, ' ', '')) + 1)::VARCHAR END AS n_words,
  (length(text) - length(replace(text, chr(10), '')) + 1)::VARCHAR AS n_lines,
  CASE WHEN NOT {q_hit(0.04, 'lang', _uid)} THEN lang END AS lang, source,
  md5(replace(replace(text, ' ', ''), chr(10), '')) AS cluster FROM documents)"""

DOC_FIELDS = ["body", "n_chars", "n_words"]
DOC_RULES = [["n_chars"], ["n_words", "n_lines"]]
DOC_RULES_2 = [["body"], ["n_chars", "n_lines"]]
DOC_FIELDS_2 = ["body", "n_chars", "lang"]

# ---- customer x supplier: linkage across two sources -----------------------------------------------------


def _party(df, key, name, nation, balance, source, suffix):
    uid = F.concat(F.col(key).cast("string"), F.lit(suffix))
    return df.select(
        uid.alias("unique_id"), F.lit(source).alias("source_dataset"),
        F.regexp_replace(name, "^[A-Za-z]+#", "").alias("name"), F.col(nation).cast("string").alias("nation"),
        F.when(~hit(0.03, "band", uid), F.floor(F.col(balance) / 1000).cast("string")).alias("band"),
        F.col(key).cast("string").alias("cluster"))


def link_a(spark, sf_dir):
    return _party(load(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_nationkey", "c_acctbal", "A", "")


def link_b(spark, sf_dir):
    return _party(load(spark, sf_dir, "supplier"), "s_suppkey", "s_name", "s_nationkey", "s_acctbal", "B", "_B")


def _q_party(view, table, p, key, source, suffix):
    uid = f"({p}_{key}::VARCHAR || '{suffix}')"
    return f"""{view} AS (SELECT {uid} AS unique_id, '{source}' AS source_dataset,
  regexp_replace({p}_name, '^[A-Za-z]+#', '') AS name, {p}_nationkey::VARCHAR AS nation,
  CASE WHEN NOT {q_hit(0.03, 'band', uid)} THEN floor({p}_acctbal / 1000)::BIGINT::VARCHAR END AS band,
  {p}_{key}::VARCHAR AS cluster FROM {table})"""


LINK = (_q_party("link_a", "customer", "c", "custkey", "A", "") + ", "
        + _q_party("link_b", "supplier", "s", "suppkey", "B", "_B"))
LINK_ALL = LINK + ", link_all AS (SELECT * FROM link_a UNION ALL SELECT * FROM link_b)"
LINK_FIELDS = ["name", "nation", "band"]
LINK_RULES = [["nation", "band"], ["name"]]

# ---- people: demographic fields over the customers ---------------------------------------------------------

PICKS = {
    "first_name": (["Anna", "Ben", "Carla", "David", "Elena", "Farid", "Grace", "Hugo"], 0.03),
    "surname": (["Adams", "Baker", "Clark", "Diaz", "Evans", "Ford", "Gray", "Hill", "Ito", "Jones", "Kaur", "Lopez"], 0.02),
    "city": (["New York", "San Jose", "Washington", "Leeds", "Saint Paul", "Rio"], 0.05),
    "gender": (["M", "F", "Unknown"], 0.0),
    "gender_code": (["M", "F", "U"], 0.02),
    "race_code": (["A", "B", "I", "M", "O", "P", "U", "W"], 0.02),
    "ethnic_code": (["HL", "NL", "UN"], 0.02),
    "party_cd": (["DEM", "REP", "UNA", "LIB", "IND"], 0.02),
    "birth_state": (["NC", "VA", "SC", "NY", " "], 0.10),
    "outward": (["SW1A", "LS2", "M1", "CF10"], 0.0),
}


def person_records(spark, sf_dir):
    uid = F.col("c_custkey").cast("string")

    def chosen(name):
        options, missing = PICKS[name]
        value = pick(F.array(*[F.lit(o) for o in options]), draw(f"pick-{name}", uid))
        return F.when(~hit(missing, f"null-{name}", uid), value) if missing else value

    # The file is small and much is made of each row, so the rows are dealt over all tasks.
    base = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").repartition(many_tasks(spark)).select(
        uid.alias("unique_id"), F.lit("A").alias("source_dataset"), *[chosen(n).alias(n) for n in PICKS],
        F.col("c_nationkey").cast("string").alias("nation"))
    uid = F.col("unique_id")
    dob = F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.pmod(draw("dob", uid), F.lit(18000)).cast("int")), "yyyy-MM-dd")
    mail = F.concat(F.lower(F.coalesce("first_name", F.lit("x"))), F.lit("."), F.lower(F.coalesce("surname", F.lit("y"))),
                    F.pmod(draw("mail", uid), F.lit(700)).cast("string"), F.lit("@example.org"))
    year = (F.pmod(draw("year", uid), F.lit(150)) + 1890).cast("string")
    return base.select(
        "*", F.when(~hit(0.04, "null-dob", uid), dob).alias("dob"), F.when(~hit(0.05, "null-mail", uid), mail).alias("email"),
        F.concat("outward", F.lit(" "), (F.pmod(draw("inward", uid), F.lit(9)) + 1).cast("string"), F.lit("AB")).alias("postcode"),
        F.when(hit(0.02, "bad-year", uid), "n/a").otherwise(year).alias("birth_year"),
        F.pmod(draw("age", uid), F.lit(135)).cast("string").alias("age_at_year_end"), uid.alias("cluster"))


def _q_pick(name):
    options, missing = PICKS[name]
    array = "[" + ", ".join(f"'{o}'" for o in options) + "]"
    value = f"{array}[(1 + {q_draw('pick-' + name, 'uid')} % {len(options)})::INT]"
    return f"CASE WHEN NOT {q_hit(missing, 'null-' + name, 'uid')} THEN {value} END AS {name}" if missing else f"{value} AS {name}"


PERSON = f"""person_base AS (SELECT uid AS unique_id, 'A' AS source_dataset, {', '.join(_q_pick(n) for n in PICKS)},
  c_nationkey::VARCHAR AS nation FROM (SELECT *, c_custkey::VARCHAR AS uid FROM customer)),
person_records AS (SELECT *,
  CASE WHEN NOT {q_hit(0.04, 'null-dob')} THEN strftime(DATE '1950-01-01' + ({q_draw('dob')} % 18000)::INT, '%Y-%m-%d') END AS dob,
  CASE WHEN NOT {q_hit(0.05, 'null-mail')} THEN lower(coalesce(first_name, 'x')) || '.' || lower(coalesce(surname, 'y')) || ({q_draw('mail')} % 700)::VARCHAR || '@example.org' END AS email,
  outward || ' ' || ({q_draw('inward')} % 9 + 1)::VARCHAR || 'AB' AS postcode,
  CASE WHEN {q_hit(0.02, 'bad-year')} THEN 'n/a' ELSE ({q_draw('year')} % 150 + 1890)::VARCHAR END AS birth_year,
  ({q_draw('age')} % 135)::VARCHAR AS age_at_year_end, unique_id AS cluster FROM person_base)"""

# ---- dirty tables for cleaning ------------------------------------------------------------------------------


def dirty_customer(spark, sf_dir):
    """Padded names, blanks, null tokens, an empty column, sparse rows and repeated rows."""
    base = load(spark, sf_dir, "customer")
    base = base.unionByName(base.where(hit(0.10, "repeat", F.col("c_custkey").cast("string"))))
    uid = F.col("c_custkey").cast("string")
    h = F.pmod(draw("dirt", uid), F.lit(20))
    name = (F.when(h == 0, F.concat(F.lit("  "), F.col("c_name"), F.lit("\t x ")))
            .when(h == 1, " N/A ").when(h == 2, "nan").when(h == 3, "   ").otherwise(F.col("c_name")))
    segment = F.when(h == 4, "NULL").when(h == 5, F.lit(None)).otherwise(F.lower("c_mktsegment"))
    date = F.date_add(F.lit("1950-01-01").cast("date"), F.pmod(draw("born", uid), F.lit(18000)).cast("int"))
    born = (F.when(h == 6, F.date_format(date, "MM/dd/yyyy")).when(h == 7, "unknown")
            .when(h == 8, F.date_format(date, "yyyyMMdd")).otherwise(F.date_format(date, "yyyy-MM-dd")))
    sparse = F.pmod(draw("sparse", uid), F.lit(25))
    keep = lambda c, most: F.when(sparse >= most, c)
    return base.select(
        keep(uid, 1).alias(" Cust ID "), keep(name, 2).alias("Cust-Name"), keep(segment, 3).alias("Segment"),
        keep(born, 4).alias("Birth Date"), keep(F.col("c_nationkey").cast("string"), 4).alias("nation"),
        F.lit(None).cast("string").alias("Unused?"))


_dirt = q_draw("dirt", "uid") + " % 20"
DIRTY = f"""dirty_base AS (SELECT *, c_custkey::VARCHAR AS uid FROM customer),
dirty_rows AS (SELECT * FROM dirty_base UNION ALL SELECT * FROM dirty_base WHERE {q_hit(0.10, 'repeat', 'uid')}),
dirty_marks AS (SELECT *, {_dirt} AS h, {q_draw('sparse', 'uid')} % 25 AS s,
  DATE '1950-01-01' + ({q_draw('born', 'uid')} % 18000)::INT AS born FROM dirty_rows),
dirty AS (SELECT CASE WHEN s >= 1 THEN uid END AS cust_id,
  CASE WHEN s >= 2 THEN CASE h WHEN 0 THEN '  ' || c_name || chr(9) || ' x ' WHEN 1 THEN ' N/A ' WHEN 2 THEN 'nan' WHEN 3 THEN '   ' ELSE c_name END END AS cust_name,
  CASE WHEN s >= 3 THEN CASE h WHEN 4 THEN 'NULL' WHEN 5 THEN NULL ELSE lower(c_mktsegment) END END AS segment,
  CASE WHEN s >= 4 THEN CASE h WHEN 6 THEN strftime(born, '%m/%d/%Y') WHEN 7 THEN 'unknown' WHEN 8 THEN strftime(born, '%Y%m%d') ELSE strftime(born, '%Y-%m-%d') END END AS birth_date,
  CASE WHEN s >= 4 THEN c_nationkey::VARCHAR END AS nation, NULL::VARCHAR AS unused FROM dirty_marks)"""
DIRTY_COLUMNS = ["cust_id", "cust_name", "segment", "birth_date", "nation", "unused"]


def mixed_dates(spark, sf_dir):
    """Order dates written in several styles, some unreadable, some missing."""
    uid = F.col("o_orderkey").cast("string")
    h = F.pmod(draw("style", uid), F.lit(10))
    day = F.col("o_orderdate")
    text = (F.when(h == 0, F.date_format(day, "MM/dd/yyyy")).when(h == 1, F.date_format(day, "yyyy/MM/dd"))
            .when(h == 2, F.date_format(day, "yyyyMMdd")).when(h == 3, F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd")))
            .when(h == 4, "not known").when(h == 5, F.lit(None)).otherwise(F.date_format(day, "yyyy-MM-dd")))
    return load(spark, sf_dir, "orders").select(
        uid.alias("unique_id"), text.alias("order_date"), F.date_format(day, "yyyy").alias("birth_year"),
        F.date_format(day, "yyyy-MM-dd").alias("registr_dt"), F.col("o_orderpriority").alias("priority"))


_style = q_draw("style", "o_orderkey::VARCHAR") + " % 10"
DATES = f"""mixed_dates AS (SELECT o_orderkey::VARCHAR AS unique_id,
  CASE {_style} WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
   WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') WHEN 3 THEN ' ' || strftime(o_orderdate, '%Y-%m-%d')
   WHEN 4 THEN 'not known' WHEN 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
  strftime(o_orderdate, '%Y') AS birth_year, strftime(o_orderdate, '%Y-%m-%d') AS registr_dt,
  o_orderpriority AS priority FROM orders)"""


def q_parse_date(text):
    return f"CAST(try_strptime({text}, ['%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%Y/%m/%d', '%Y%m%d']) AS DATE)"


# ---- pairs ------------------------------------------------------------------------------------------------------

def q_rule(rule, l="a", r="b"):
    return "(" + " AND ".join(f"{l}.{f} = {r}.{f}" for f in rule) + ")"


def q_node(t, uid="unique_id", source="source_dataset"):
    return f"({t}.{source} || '-' || {t}.{uid})"


def q_pairs(table, rules, fields, other=None, extra=""):
    """Brute force: one join on the OR of all rules."""
    needed = list(dict.fromkeys([f for rule in rules for f in rule] + list(fields)))
    key = " ".join(f"WHEN {q_rule(rule)} THEN {i}" for i, rule in enumerate(rules))
    shown = ", ".join(f"a.{f} AS {f}_l, b.{f} AS {f}_r" for f in needed)
    guard = "" if other else f" AND {q_node('a')} < {q_node('b')}"
    return f"""SELECT a.unique_id AS unique_id_l, b.unique_id AS unique_id_r, a.source_dataset AS source_dataset_l,
  b.source_dataset AS source_dataset_r, (CASE {key} END)::INT AS match_key, {shown}{extra}
  FROM {table} a JOIN {other or table} b ON ({' OR '.join(q_rule(r) for r in rules)}){guard}"""


def q_agree(fields, l="_l", r="_r"):
    return " + ".join(f"coalesce(({f}{l} = {f}{r})::INT, 0)" for f in fields)


def q_deterministic(table, rules, fields, other=None):
    need = min(2 if len(fields) > 1 else 1, len(fields))
    return (f"SELECT *, 1.0::DOUBLE AS match_probability, 100.0::DOUBLE AS match_weight FROM "
            f"({q_pairs(table, rules, fields, other)}) WHERE {q_agree(fields)} >= {need}")


# ---- a fixed model over part, and two scored runs -----------------------------------------------------------------

PRIOR = 0.01
M_U = {   # m and u per level below the null level
    "name": [(0.80, 0.03), (0.08, 0.10), (0.07, 0.30), (0.05, 0.57)],
    "brand": [(0.90, 0.04), (0.10, 0.96)],
    "type": [(0.85, 0.17), (0.15, 0.83)],
    "size": [(0.90, 0.02), (0.06, 0.18), (0.02, 0.60), (0.02, 0.20)],
}
COMPARATORS = {"name": "JaroWinklerAtThresholds", "size": "LevenshteinAtThresholds"}
RUN1_RULES = [["brand", "size"], ["name", "size"]]
RUN2_RULES = [["name", "brand"], ["brand", "type", "size"]]


def part_model():
    comparisons = build_comparisons(PART_FIELDS, COMPARATORS)
    for c in comparisons:
        real = [level for level in c["comparison_levels"] if not level["is_null_level"]]
        for level, (m, u) in zip(real, M_U[c["output_column_name"]]):
            level["m_probability"], level["u_probability"] = m, u
    return {"link_type": "dedupe_only", "unique_id_column_name": "unique_id", "comparisons": comparisons,
            "probability_two_random_records_match": PRIOR,
            "blocking_rules_to_generate_predictions": [{"blocking_rule": blocking.rule_sql(r)} for r in RUN1_RULES]}


def score_columns(pairs):
    """Scores at six digits, so that every engine groups them alike."""
    return (pairs.withColumn("match_weight", rounded(F.col("match_weight"), 6))
            .withColumn("match_probability", rounded(F.col("match_probability"), 6)))


def folded_run(spark, sf_dir, rules):
    """The pairs of a run, folded where many records are alike."""
    return score_columns(scoring.predict_folded(part_records(spark, sf_dir), rules, part_model()))


def counted_run(spark, sf_dir, rules=RUN1_RULES):
    """The folded pairs of a run with the number of record pairs in each, for what counts pairs or looks at records."""
    return blocking.weighed(folded_run(spark, sf_dir, rules))


def run_pairs(spark, sf_dir, rules):
    return blocking.unfold(folded_run(spark, sf_dir, rules))


def run1(spark, sf_dir):
    return run_pairs(spark, sf_dir, RUN1_RULES)


def run2(spark, sf_dir):
    return run_pairs(spark, sf_dir, RUN2_RULES)


Q_GAMMA = {
    "name": "CASE WHEN name_l IS NULL OR name_r IS NULL THEN -1 WHEN name_l = name_r THEN 3 "
            "WHEN jaro_winkler_similarity(name_l, name_r) >= 0.9 THEN 2 WHEN jaro_winkler_similarity(name_l, name_r) >= 0.7 THEN 1 ELSE 0 END",
    "brand": "CASE WHEN brand_l IS NULL OR brand_r IS NULL THEN -1 WHEN brand_l = brand_r THEN 1 ELSE 0 END",
    "type": "CASE WHEN type_l IS NULL OR type_r IS NULL THEN -1 WHEN type_l = type_r THEN 1 ELSE 0 END",
    "size": "CASE WHEN size_l IS NULL OR size_r IS NULL THEN -1 WHEN size_l = size_r THEN 3 "
            "WHEN levenshtein(size_l, size_r) <= 1 THEN 2 WHEN levenshtein(size_l, size_r) <= 2 THEN 1 ELSE 0 END",
}


def q_weight(m_u=None, prior=PRIOR):
    total = f"{math.log2(prior / (1 - prior))!r}::DOUBLE"
    for f, levels in (m_u or M_U).items():
        top = len(levels) - 1
        steps = " ".join(f"WHEN {top - i} THEN log2({m}::DOUBLE / {u}::DOUBLE)" for i, (m, u) in enumerate(levels))
        total += f" + CASE gamma_{f} {steps} ELSE 0.0::DOUBLE END"
    return total


def q_run(name, rules):
    gammas = ", ".join(f"({Q_GAMMA[f]})::INT AS gamma_{f}" for f in PART_FIELDS)
    return f"""{name}_pairs AS ({q_pairs('part_records', rules, PART_FIELDS)}),
{name}_gammas AS (SELECT *, {gammas} FROM {name}_pairs),
{name}_weights AS (SELECT *, {q_weight()} AS w FROM {name}_gammas),
{name} AS (SELECT * EXCLUDE (w), {q_round('w', 6)} AS match_weight,
  {q_round('pow(2.0::DOUBLE, w) / (1.0::DOUBLE + pow(2.0::DOUBLE, w))', 6)} AS match_probability FROM {name}_weights WHERE w >= -5)"""


RUN1 = PART + ", " + q_run("run1", RUN1_RULES)
RUN2 = q_run("run2", RUN2_RULES)
BOTH_RUNS = RUN1 + ", " + RUN2

# ---- clusters of the documents --------------------------------------------------------------------------------------

def q_components(records, edges, out, threshold=0.8):
    """Connected components by recursive reachability; the id is the smallest member."""
    return f"""{out}_e AS (SELECT {q_node('p', 'unique_id_l', 'source_dataset_l')} AS x, {q_node('p', 'unique_id_r', 'source_dataset_r')} AS y
  FROM {edges} p WHERE match_probability >= {threshold}),
{out}_both AS (SELECT x, y FROM {out}_e UNION SELECT y, x FROM {out}_e),
{out}_reach AS (SELECT {q_node('r')} AS x, {q_node('r')} AS y FROM {records} r
  UNION SELECT t.x, b.y FROM {out}_reach t JOIN {out}_both b ON t.y = b.x),
{out}_label AS (SELECT x, min(y) AS cluster_id FROM {out}_reach GROUP BY x),
{out} AS (SELECT r.*, l.cluster_id FROM {records} r JOIN {out}_label l ON l.x = {q_node('r')})"""


def doc_clusters(spark, sf_dir, rules=DOC_RULES, fields=DOC_FIELDS):
    records = narrow_docs(spark, sf_dir)
    return cluster_records(records, blocking.deterministic_links(records, rules, fields))


def doc_pairs(spark, sf_dir, rules=DOC_RULES, fields=DOC_FIELDS):
    return blocking.deterministic_pairs(narrow_docs(spark, sf_dir), rules, fields)


def link_clusters(spark, sf_dir):
    a, b = link_a(spark, sf_dir), link_b(spark, sf_dir)
    return cluster_records(a.unionByName(b), blocking.deterministic_links(a, LINK_RULES, LINK_FIELDS, b))


DOC_RUN = DOC + f", doc_pairs AS ({q_deterministic('doc_records', DOC_RULES, DOC_FIELDS)}), " + q_components("doc_records", "doc_pairs", "doc_clusters")
DOC_RUN_2 = f"doc_pairs2 AS ({q_deterministic('doc_records', DOC_RULES_2, DOC_FIELDS_2)}), " + q_components("doc_records", "doc_pairs2", "doc_clusters2")
LINK_RUN = LINK_ALL + f", link_pairs AS ({q_deterministic('link_a', LINK_RULES, LINK_FIELDS, 'link_b')}), " + q_components("link_all", "link_pairs", "link_clusters")


def with_recursive(*parts):
    return "WITH RECURSIVE " + ", ".join(parts) + " "

# ---- people against a noisy copy of them: true links with typos, shifted dates, missing values ------------------------------


def noisy_people(spark, sf_dir):
    """Every person again with errors; the truth cluster is the id of the original."""
    from kinsift.operators import perturb

    key = F.col("unique_id")
    people = person_records(spark, sf_dir)
    change = {
        "first_name": F.when(hit(0.5, "n-first", key), perturb.typo(F.col("first_name"), "n-first", key)).otherwise(F.col("first_name")),
        "surname": F.when(hit(0.3, "n-last", key), perturb.typo(F.col("surname"), "n-last", key)).otherwise(F.col("surname")),
        "email": F.when(hit(0.5, "n-mail", key), perturb.email_variant(F.col("email"), "n-mail", key)).otherwise(F.col("email")),
        "dob": F.when(hit(0.2, "n-dob", key), perturb.shift_date(F.col("dob")))
                .when(hit(0.2, "n-swap", key), F.expr("concat(substr(dob, 1, 8), substr(dob, 10, 1), substr(dob, 9, 1))"))
                .when(hit(0.1, "n-none", key), F.lit(None)).otherwise(F.col("dob")),
        "postcode": F.when(hit(0.3, "n-post", key), F.replace("postcode", F.lit("AB"), F.lit("XY")))
                     .when(hit(0.2, "n-sector", key), F.expr("concat(outward, ' 9ZZ')")).otherwise(F.col("postcode")),
    }
    shown = [change[c].alias(c) if c in change else F.col(c) for c in people.columns if c not in ("unique_id", "source_dataset")]
    return people.select(F.concat("unique_id", F.lit("_B")).alias("unique_id"), F.lit("B").alias("source_dataset"), *shown)


PEOPLE_RULES = [["surname", "birth_year", "gender"], ["dob"], ["email"]]
PEOPLE_FIELDS = ["first_name", "surname", "dob", "email", "postcode"]
PEOPLE_TYPES = {"first_name": "NameComparison", "surname": "JaroAtThresholds", "dob": "DateOfBirthComparison",
                "email": "EmailComparison", "postcode": "PostcodeComparison"}
PEOPLE_M_U = {
    "first_name": [(0.50, 0.125), (0.20, 0.01), (0.10, 0.01), (0.15, 0.05), (0.05, 0.805)],
    "surname": [(0.70, 0.09), (0.05, 0.01), (0.20, 0.05), (0.05, 0.85)],
    "dob": [(0.55, 0.0005), (0.20, 0.001), (0.05, 0.004), (0.10, 0.04), (0.05, 0.30), (0.05, 0.6545)],
    "email": [(0.50, 0.01), (0.25, 0.01), (0.15, 0.05), (0.05, 0.05), (0.05, 0.88)],
    "postcode": [(0.56, 0.03), (0.24, 0.01), (0.15, 0.20), (0.03, 0.01), (0.02, 0.75)],
}
PEOPLE_PRIOR = 0.001


def people_model():
    comparisons = build_comparisons(PEOPLE_FIELDS, PEOPLE_TYPES)
    for c in comparisons:
        real = [level for level in c["comparison_levels"] if not level["is_null_level"]]
        for level, (m, u) in zip(real, PEOPLE_M_U[c["output_column_name"]]):
            level["m_probability"], level["u_probability"] = m, u
    return {"link_type": "link_only", "unique_id_column_name": "unique_id", "comparisons": comparisons,
            "probability_two_random_records_match": PEOPLE_PRIOR,
            "blocking_rules_to_generate_predictions": [{"blocking_rule": blocking.rule_sql(r)} for r in PEOPLE_RULES]}


LINKED = ["unique_id", "source_dataset", "first_name", "surname", "dob", "email", "postcode", "birth_year", "gender", "race_code", "cluster"]


def people_tables(spark, sf_dir):
    """Both tables, written once as a run would keep them."""
    return (materialise(person_records(spark, sf_dir).select(*LINKED)), materialise(noisy_people(spark, sf_dir).select(*LINKED)))


def people_run(spark, sf_dir, rules=PEOPLE_RULES):
    """Scored pairs, and all records."""
    a, b = people_tables(spark, sf_dir)
    return score_columns(scoring.predict(a, rules, people_model(), b, keep=["cluster"])), a.unionByName(b)


def people_pairs(spark, sf_dir, rules=PEOPLE_RULES):
    return people_run(spark, sf_dir, rules)[0]


def _q_noisy():
    from queries import noise_sql as q

    shift = q.q_shift_date("dob")
    return f"""noisy_people AS (SELECT * REPLACE (unique_id || '_B' AS unique_id, 'B' AS source_dataset,
  CASE WHEN {q_hit(0.5, 'n-first')} THEN {q.q_typo('first_name', 'n-first')} ELSE first_name END AS first_name,
  CASE WHEN {q_hit(0.3, 'n-last')} THEN {q.q_typo('surname', 'n-last')} ELSE surname END AS surname,
  CASE WHEN {q_hit(0.5, 'n-mail')} THEN {q.q_email_variant('email', 'n-mail')} ELSE email END AS email,
  CASE WHEN {q_hit(0.2, 'n-dob')} THEN {shift} WHEN {q_hit(0.2, 'n-swap')} THEN substr(dob, 1, 8) || substr(dob, 10, 1) || substr(dob, 9, 1)
   WHEN {q_hit(0.1, 'n-none')} THEN NULL ELSE dob END AS dob,
  CASE WHEN {q_hit(0.3, 'n-post')} THEN replace(postcode, 'AB', 'XY') WHEN {q_hit(0.2, 'n-sector')} THEN outward || ' 9ZZ' ELSE postcode END AS postcode)
  FROM person_records),
people_all AS (SELECT * FROM person_records UNION ALL SELECT * FROM noisy_people)"""


def q_ladder(field, steps, null=None):
    """A gamma CASE from the conditions above the else level."""
    l, r = f"{field}_l", f"{field}_r"
    top = len(steps)
    cases = " ".join(f"WHEN {s} THEN {top - i}" for i, s in enumerate(steps))
    return f"(CASE WHEN {null or f'{l} IS NULL OR {r} IS NULL'} THEN -1 {cases} ELSE 0 END)::INT"


def q_similar(function, field, thresholds):
    return [f"{function}({field}_l, {field}_r) >= {t}" for t in thresholds]


def q_part_of(field, pattern):
    l, r = f"regexp_extract({field}_l, '{pattern}')", f"regexp_extract({field}_r, '{pattern}')"
    return f"{l} <> '' AND {l} = {r}"


def q_same(field):
    return f"{field}_l = {field}_r"


def q_dob_gamma(f):
    l, r = f"try_strptime({f}_l, '%Y-%m-%d')::DATE", f"try_strptime({f}_r, '%Y-%m-%d')::DATE"
    near = [f"abs(date_diff('day', {l}, {r})) <= {n}" for n in (30, 365, 3650)]
    return q_ladder(f, [q_same(f), f"damerau_levenshtein({f}_l, {f}_r) <= 1"] + near, f"{l} IS NULL OR {r} IS NULL")


def q_email_gamma(f):
    ul, ur = f"split_part({f}_l, '@', 1)", f"split_part({f}_r, '@', 1)"
    return q_ladder(f, [q_same(f), f"{ul} = {ur}", f"jaro_winkler_similarity({f}_l, {f}_r) >= 0.88", f"jaro_winkler_similarity({ul}, {ur}) >= 0.88"])


def q_postcode_gamma(f):
    return q_ladder(f, [q_same(f), q_part_of(f, "^[A-Z]{1,2}[0-9][A-Z0-9]? [0-9]"), q_part_of(f, "^[A-Z]{1,2}[0-9][A-Z0-9]?"), q_part_of(f, "^[A-Z]{1,2}")])


Q_PEOPLE_GAMMA = {
    "first_name": q_ladder("first_name", [q_same("first_name")] + q_similar("jaro_winkler_similarity", "first_name", [0.92, 0.88, 0.7])),
    "surname": q_ladder("surname", [q_same("surname")] + q_similar("jaro_similarity", "surname", [0.9, 0.7])),
    "dob": q_dob_gamma("dob"), "email": q_email_gamma("email"), "postcode": q_postcode_gamma("postcode"),
}


def q_people_run(name="people_run", rules=PEOPLE_RULES):
    gammas = ", ".join(f"{Q_PEOPLE_GAMMA[f]} AS gamma_{f}" for f in PEOPLE_FIELDS)
    return f"""{name}_pairs AS ({q_pairs('person_records', rules, PEOPLE_FIELDS + ['cluster'], 'noisy_people')}),
{name}_gammas AS (SELECT *, {gammas} FROM {name}_pairs),
{name}_weights AS (SELECT *, {q_weight(PEOPLE_M_U, PEOPLE_PRIOR)} AS w FROM {name}_gammas),
{name} AS (SELECT * EXCLUDE (w), {q_round('w', 6)} AS match_weight,
  {q_round('pow(2.0::DOUBLE, w) / (1.0::DOUBLE + pow(2.0::DOUBLE, w))', 6)} AS match_probability FROM {name}_weights WHERE w >= -5)"""


PEOPLE = PERSON + ", " + _q_noisy()
PEOPLE_RUN = PEOPLE + ", " + q_people_run()
