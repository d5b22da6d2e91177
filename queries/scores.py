"""Comparators, training, scoring, models."""
from pyspark.sql import functions as F

from kinsift.functions import similarity
from kinsift.functions.numbers import rounded
from kinsift.operators import blocking, reports, scoring, training
from kinsift.operators.comparators import build_comparisons, with_gammas
from kinsift.plans.linker import LinkConfig, Linker
from kinsift.sources import models
from queries import fixtures as x
from queries.blocks import IDS
from queries.cleaning import shared_path
from queries.fixtures import q_draw, q_ladder, q_pairs, q_round, q_same, q_similar, q_with, with_recursive
from queries.registry import query

Q_CANDIDATES = x.PEOPLE + f", cand AS ({q_pairs('person_records', x.PEOPLE_RULES, x.PEOPLE_FIELDS, 'noisy_people')})"


def candidates(spark, sf_dir):
    a, b = x.people_tables(spark, sf_dir)
    return blocking.candidate_pairs(a, x.PEOPLE_RULES, x.PEOPLE_FIELDS, b)


def comparator(name, kind, field, sql):
    """A query that shows the gamma of one comparator."""
    @query(name, q_with(Q_CANDIDATES) + f"SELECT {IDS}, {sql} AS gamma_{field} FROM cand")
    def run(spark, sf_dir):
        scored = with_gammas(candidates(spark, sf_dir), build_comparisons([field], {field: kind}))
        return scored.select(*IDS.split(", "), f"gamma_{field}")


def q_steps(field, function, thresholds):
    return q_ladder(field, [q_same(field)] + q_similar(function, field, thresholds))


comparator("cmp_exact", "ExactMatch", "postcode", q_ladder("postcode", [q_same("postcode")]))
comparator("cmp_name", "NameComparison", "first_name", q_steps("first_name", "jaro_winkler_similarity", [0.92, 0.88, 0.7]))
comparator("cmp_dob", "DateOfBirthComparison", "dob", x.q_dob_gamma("dob"))
comparator("cmp_levenshtein", "LevenshteinAtThresholds", "surname",
           q_ladder("surname", [q_same("surname"), "levenshtein(surname_l, surname_r) <= 1", "levenshtein(surname_l, surname_r) <= 2"]))
comparator("cmp_jaro_winkler", "JaroWinklerAtThresholds", "email", q_steps("email", "jaro_winkler_similarity", [0.9, 0.7]))
comparator("cmp_jaro", "JaroAtThresholds", "surname", q_steps("surname", "jaro_similarity", [0.9, 0.7]))
comparator("cmp_email", "EmailComparison", "email", x.q_email_gamma("email"))
comparator("cmp_postcode", "PostcodeComparison", "postcode", x.q_postcode_gamma("postcode"))


@query("fn_jaro_winkler", q_with(Q_CANDIDATES) + f"""SELECT {IDS}, {q_round('jaro_winkler_similarity(email_l, email_r)', 9)} AS jaro_winkler,
  {q_round('jaro_similarity(email_l, email_r)', 9)} AS jaro FROM cand""")
def fn_jaro_winkler(spark, sf_dir):
    return candidates(spark, sf_dir).select(
        *IDS.split(", "), rounded(similarity.jaro_winkler_similarity("email_l", "email_r"), 9).alias("jaro_winkler"),
        rounded(similarity.jaro_similarity("email_l", "email_r"), 9).alias("jaro"))


@query("fn_damerau", q_with(Q_CANDIDATES) + f"""SELECT {IDS}, damerau_levenshtein(surname_l, surname_r)::INT AS distance,
  damerau_levenshtein(dob_l, dob_r)::INT AS dob_distance FROM cand""")
def fn_damerau(spark, sf_dir):
    return candidates(spark, sf_dir).select(
        *IDS.split(", "), similarity.damerau_levenshtein("surname_l", "surname_r").alias("distance"),
        similarity.damerau_levenshtein("dob_l", "dob_r").alias("dob_distance"))


# ---- scoring ------------------------------------------------------------------------------------------------------------

GAMMAS = ", ".join(f"gamma_{f}" for f in x.PART_FIELDS)


@query("gamma_vectors", q_with(x.RUN1) + f"SELECT {IDS}, match_key, {GAMMAS} FROM run1_gammas")
def gamma_vectors(spark, sf_dir):
    pairs = blocking.candidate_pairs(x.part_records(spark, sf_dir), x.RUN1_RULES, x.PART_FIELDS, folded=True)
    return blocking.unfold(with_gammas(pairs, x.part_model()["comparisons"])).select(*IDS.split(", "), "match_key", *GAMMAS.split(", "))


@query("score_pairs", q_with(x.RUN1) + f"SELECT {IDS}, match_key, {GAMMAS}, match_weight, match_probability FROM run1")
def score_pairs(spark, sf_dir):
    return x.run1(spark, sf_dir).select(*IDS.split(", "), "match_key", *GAMMAS.split(", "), "match_weight", "match_probability")


WIDE_RULES = [["brand"], ["name"]]


@query("score_pairs_pruned", q_with(x.PART, x.q_run("wide", WIDE_RULES)) + f"SELECT {IDS}, match_key, match_weight, match_probability FROM wide WHERE match_weight >= 2")
def score_pairs_pruned(spark, sf_dir):
    """Wide rules under a high threshold: hopeless pairs are never made, the result is the same."""
    pairs = scoring.predict(x.part_records(spark, sf_dir), WIDE_RULES, x.part_model(), threshold=2.0)
    return x.score_columns(pairs).select(*IDS.split(", "), "match_key", "match_weight", "match_probability")


PEOPLE_GAMMAS = ", ".join(f"gamma_{f}" for f in x.PEOPLE_FIELDS)


@query("score_link", q_with(x.PEOPLE_RUN) + f"SELECT {IDS}, match_key, {PEOPLE_GAMMAS}, match_weight, match_probability FROM people_run")
def score_link(spark, sf_dir):
    return x.people_pairs(spark, sf_dir).select(*IDS.split(", "), "match_key", *PEOPLE_GAMMAS.split(", "), "match_weight", "match_probability")


@query("score_from_model", q_with(x.RUN1) + f"SELECT {IDS}, match_key, {GAMMAS}, match_weight, match_probability FROM run1")
def score_from_model(spark, sf_dir):
    """A model document is written, read back and replayed."""
    path = shared_path(spark, "model")
    models.write_model(spark, x.part_model(), path)
    run = Linker.from_model(x.part_records(spark, sf_dir), models.read_model(spark, path))
    return blocking.unfold(x.score_columns(run.folded())).select(*IDS.split(", "), "match_key", *GAMMAS.split(", "), "match_weight", "match_probability")


# ---- training -----------------------------------------------------------------------------------------------------------

def _q_prior(rule):
    key = ", ".join(rule)
    there = " AND ".join(f"{f} IS NOT NULL" for f in rule)
    return f"""prior AS (SELECT c.n_pairs, t.all_pairs, least(c.n_pairs / 0.6::DOUBLE / t.all_pairs, 1.0::DOUBLE) AS prior FROM
  (SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS n_pairs FROM (SELECT count(*) AS n FROM part_records WHERE {there} GROUP BY {key})) c,
  (SELECT (count(*) * (count(*) - 1) // 2)::BIGINT AS all_pairs FROM part_records) t)"""


@query("estimate_prior", q_with(x.PART, _q_prior(["name"])) + f"SELECT n_pairs, all_pairs, {q_round('prior', 9)} AS prior FROM prior")
def estimate_prior(spark, sf_dir):
    return training.estimate_prior(x.part_records(spark, sf_dir), ["name"]).withColumn("prior", rounded(F.col("prior"), 9))


@query("rank_training_fields", q_with(x.PART) + """SELECT position, field, n_pairs FROM (VALUES (0::BIGINT, 'brand'), (1, 'name'), (2, 'size')) t(position, field) JOIN (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS n_pairs FROM (SELECT count(*) AS n FROM part_records WHERE {f} IS NOT NULL GROUP BY {f})"
    for f in ("brand", "name", "size")) + ") USING (field) WHERE n_pairs > 0")
def rank_training_fields(spark, sf_dir):
    """Fields to block on while training, in order, with the pairs they share: rules of one field switched on, composites and unselected fields left out."""
    toggles = {"size": True, "type": False, "brand+type": True, "name": True, "brand": True, "colour": True}
    ranked = training.rank_training_fields(x.PART_FIELDS, toggles)
    places = spark.createDataFrame(list(enumerate(ranked)), "position long, field string")
    return places.join(blocking.field_counts(x.part_records(spark, sf_dir), ranked), "field").where("n_pairs > 0").select("position", "field", "n_pairs")


SAMPLE, REACH = training.U_SAMPLE_RECORDS, training.U_SAMPLE_PAIRS // training.U_SAMPLE_RECORDS
Q_U = f"""n AS (SELECT count(*) AS n FROM part_records),
ranked AS (SELECT *, row_number() OVER (ORDER BY {q_draw('u')}, unique_id) - 1 AS pos, count(*) OVER () AS k_size FROM part_records, n
  WHERE n <= {SAMPLE} OR {q_draw('u')} < floor({SAMPLE}::DOUBLE / n * 4294967296)),
upairs AS (SELECT {', '.join(f'a.{f} AS {f}_l, b.{f} AS {f}_r' for f in x.PART_FIELDS)} FROM ranked a, range(1, {REACH + 1}) s(step), ranked b
  WHERE step <= (a.k_size - 1) // 2 AND b.pos = (a.pos + step) % a.k_size),
ugammas AS (SELECT {', '.join(f'({x.Q_GAMMA[f]})::INT AS gamma_{f}' for f in x.PART_FIELDS)} FROM upairs),
ulong AS ({' UNION ALL '.join(f"SELECT '{f}' AS field, gamma_{f} AS gamma FROM ugammas WHERE gamma_{f} >= 0" for f in x.PART_FIELDS)}),
u AS (SELECT field, gamma, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY field) AS u_prob FROM ulong GROUP BY field, gamma)"""


@query("estimate_u", q_with(x.PART, Q_U) + f"SELECT field, gamma, n, {q_round('u_prob', 9)} AS u_prob FROM u")
def estimate_u(spark, sf_dir):
    u = training.estimate_u(x.part_records(spark, sf_dir), x.part_model()["comparisons"])
    return u.withColumn("u_prob", rounded(F.col("u_prob"), 9))


HELD_OUT = "size"
EM_FIELDS = [f for f in x.PART_FIELDS if f != HELD_OUT]
EM_GAMMAS = ", ".join(f"gamma_{f}" for f in EM_FIELDS)
Q_PATTERNS = f"""block AS ({q_pairs('part_records', [[HELD_OUT]], EM_FIELDS)}),
patterns AS (SELECT {EM_GAMMAS}, count(*) AS n FROM (SELECT {', '.join(f'({x.Q_GAMMA[f]})::INT AS gamma_{f}' for f in EM_FIELDS)} FROM block) GROUP BY ALL)"""


def em_comparisons():
    return [c for c in x.part_model()["comparisons"] if c["output_column_name"] != HELD_OUT]


@query("em_pattern_counts", q_with(x.PART, Q_PATTERNS) + "SELECT * FROM patterns")
def em_pattern_counts(spark, sf_dir):
    return training.pattern_counts(x.part_records(spark, sf_dir), [HELD_OUT], em_comparisons())


def start_values():
    u = {f: {len(x.M_U[f]) - 1 - i: level[1] for i, level in enumerate(x.M_U[f])} for f in EM_FIELDS}
    return {c["output_column_name"]: training.starting_m(c) for c in em_comparisons()}, u


def _q_likelihood(values):
    return " * ".join("CASE gamma_{} {} ELSE 1.0::DOUBLE END".format(
        f, " ".join(f"WHEN {g} THEN {p!r}::DOUBLE" for g, p in values[f].items())) for f in EM_FIELDS)


def q_em():
    m, u = start_values()
    match, other = f"{x.PRIOR}::DOUBLE * {_q_likelihood(m)}", f"{1 - x.PRIOR}::DOUBLE * {_q_likelihood(u)}"
    parts = [f"""SELECT '{f}' AS field, {g}::INT AS gamma, sum(CASE WHEN gamma_{f} = {g} THEN n * p END) / sum(CASE WHEN gamma_{f} >= 0 THEN n * p END) AS m_prob FROM expected"""
             for f in EM_FIELDS for g in m[f]]
    return f"expected AS (SELECT *, {match} / ({match} + {other}) AS p FROM patterns), em AS ({' UNION ALL '.join(parts)})"


@query("em_single_step", q_with(x.PART, Q_PATTERNS, q_em()) + f"SELECT field, gamma, {q_round('m_prob', 9)} AS m_prob FROM em")
def em_single_step(spark, sf_dir):
    m, u = start_values()
    step = training.em_step(em_pattern_counts(spark, sf_dir), m, u, x.PRIOR)
    return training.em_rows(step, m).select("field", "gamma", rounded(F.col("m_prob"), 9).alias("m_prob"))


def q_session(held_out, k):
    """One EM step over the pairs that share a field, for the other fields."""
    fields = [f for f in x.PART_FIELDS if f != held_out]
    m = {c["output_column_name"]: training.starting_m(c) for c in x.part_model()["comparisons"] if c["output_column_name"] in fields}
    u = {f: {len(x.M_U[f]) - 1 - i: level[1] for i, level in enumerate(x.M_U[f])} for f in fields}
    likelihood = lambda values: " * ".join("CASE gamma_{} {} ELSE 1.0::DOUBLE END".format(
        f, " ".join(f"WHEN {g} THEN {p!r}::DOUBLE" for g, p in values[f].items())) for f in fields)
    match, other = f"{x.PRIOR}::DOUBLE * {likelihood(m)}", f"{1 - x.PRIOR}::DOUBLE * {likelihood(u)}"
    steps = " UNION ALL ".join(
        f"SELECT '{f}' AS field, {g}::INT AS gamma, sum(CASE WHEN gamma_{f} = {g} THEN p END) / sum(CASE WHEN gamma_{f} >= 0 THEN p END) AS m_prob FROM e{k}" for f in fields for g in m[f])
    gammas = ", ".join(f"({x.Q_GAMMA[f]})::INT AS gamma_{f}" for f in fields)
    return f"b{k} AS ({q_pairs('part_records', [[held_out]], fields)}), g{k} AS (SELECT {gammas} FROM b{k}), e{k} AS (SELECT *, {match} / ({match} + {other}) AS p FROM g{k}), s{k} AS ({steps})"


SESSIONS = ["size", "type"]


@query("merge_sessions", q_with(x.PART, *[q_session(f, k) for k, f in enumerate(SESSIONS)])
       + f"SELECT field, gamma, {q_round('avg(m_prob)', 7)} AS m_prob FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1) WHERE m_prob IS NOT NULL GROUP BY field, gamma")
def merge_sessions(spark, sf_dir):
    """One m per level from two sessions, each one step of EM over the pairs that share its field."""
    parts, sessions = x.part_records(spark, sf_dir), []
    for held_out in SESSIONS:
        comparisons = [c for c in x.part_model()["comparisons"] if c["output_column_name"] != held_out]
        u = {f: {len(x.M_U[f]) - 1 - i: level[1] for i, level in enumerate(x.M_U[f])} for f in x.PART_FIELDS if f != held_out}
        start = {c["output_column_name"]: training.starting_m(c) for c in comparisons}
        m, _, unseen = training.em_train(training.pattern_counts(parts, [held_out], comparisons), start, u, x.PRIOR, 1, 0.0)
        sessions.append({f: {g: p for g, p in levels.items() if (f, g) not in unseen} for f, levels in m.items()})
    rows = [(f, g, float(p)) for f, levels in training.merge_sessions(sessions).items() for g, p in levels.items()]
    return spark.createDataFrame(rows, "field string, gamma int, m_prob double").withColumn("m_prob", rounded(F.col("m_prob"), 7))


ROUNDS = 3


def q_em_rounds():
    """Each round reads the values of the round before; a level that no pair shows keeps its start."""
    m, u = start_values()
    other = _q_likelihood(u)
    parts = [f"prior0 AS (SELECT {x.PRIOR}::DOUBLE AS prior)",
             "m0(field, gamma, m_prob, seen) AS (VALUES " + ", ".join(f"('{f}', {g}::INT, {p!r}::DOUBLE, true)" for f in m for g, p in m[f].items()) + ")"]
    for k in range(ROUNDS):
        match = " * ".join("CASE gamma_{} {} ELSE 1.0::DOUBLE END".format(f, " ".join(
            f"WHEN {g} THEN (SELECT m_prob FROM m{k} WHERE field = '{f}' AND gamma = {g})" for g in m[f])) for f in EM_FIELDS)
        parts += [f"e{k + 1} AS MATERIALIZED (SELECT patterns.*, prior * {match} AS yes, (1 - prior) * {other} AS no FROM patterns, prior{k})",
                  f"prior{k + 1} AS (SELECT sum(n * (yes / (yes + no))) / sum(n) AS prior FROM e{k + 1})",
                  f"m{k + 1} AS MATERIALIZED (SELECT field, gamma, greatest(coalesce(v, old), 1e-10) AS m_prob, v IS NOT NULL AS seen FROM (" + " UNION ALL ".join(
                      f"""SELECT '{f}' AS field, {g}::INT AS gamma, (SELECT sum(CASE WHEN gamma_{f} = {g} THEN n * (yes / (yes + no)) END) / sum(CASE WHEN gamma_{f} >= 0 THEN n * (yes / (yes + no)) END) FROM e{k + 1}) AS v,
  (SELECT m_prob FROM m{k} WHERE field = '{f}' AND gamma = {g}) AS old""" for f in EM_FIELDS for g in m[f]) + "))"]
    return ", ".join(parts)


@query("em_train", q_with(x.PART, Q_PATTERNS, q_em_rounds()) + f"SELECT field, gamma, {q_round('m_prob', 7)} AS m_prob, seen FROM m{ROUNDS}")
def em_train(spark, sf_dir):
    """Three rounds of EM over the pattern table."""
    m, u = start_values()
    trained, _, unseen = training.em_train(em_pattern_counts(spark, sf_dir), m, u, x.PRIOR, ROUNDS, 0.0)
    rows = [(f, g, float(p), (f, g) not in unseen) for f in trained for g, p in trained[f].items()]
    return spark.createDataFrame(rows, "field string, gamma int, m_prob double, seen boolean").withColumn("m_prob", rounded(F.col("m_prob"), 7))


# ---- the model as tables: u from random pairs and m from one EM step over the records ------------------------------------------

def estimated_model(spark, sf_dir):
    """The part model with the values estimated from the records (a few numbers per field)."""
    model = x.part_model()
    estimated = {}
    for row in estimate_u(spark, sf_dir).collect():
        estimated[(row["field"], row["gamma"], "u")] = row["u_prob"]
    for row in em_single_step(spark, sf_dir).collect():
        estimated[(row["field"], row["gamma"], "m")] = row["m_prob"]
    for c in model["comparisons"]:
        f = c["output_column_name"]
        top = len(x.M_U[f]) - 1
        for i, level in enumerate([lv for lv in c["comparison_levels"] if not lv["is_null_level"]]):
            level["u_probability"] = estimated.get((f, top - i, "u"))
            if f != HELD_OUT:
                level["m_probability"] = estimated.get((f, top - i, "m"))
    return model


def q_levels():
    rows = []
    for c in x.part_model()["comparisons"]:
        f = c["output_column_name"]
        top = len(x.M_U[f]) - 1
        gamma = top + 1
        for i, level in enumerate(c["comparison_levels"]):
            null = level["is_null_level"]
            gamma = -1 if null else (top - (i - 1))
            fixed = "NULL" if null else (repr(x.M_U[f][i - 1][0]) if f == HELD_OUT else "NULL")
            text = level["sql_condition"].replace("'", "''")
            rows.append(f"('{f}', {i}::INT, {gamma}::INT, '{level['label_for_charts']}', '{text}', {null}, {fixed}::DOUBLE)")
    return f"""lv(field, level, gamma, label, condition, is_null, fixed_m) AS (VALUES {', '.join(rows)}),
params AS (SELECT lv.field, level, lv.gamma, label, condition, is_null, coalesce(fixed_m, {q_round('em.m_prob', 9)}) AS m_prob, {q_round('u.u_prob', 9)} AS u_prob
  FROM lv LEFT JOIN em ON em.field = lv.field AND em.gamma = lv.gamma LEFT JOIN u ON u.field = lv.field AND u.gamma = lv.gamma),
weights AS (SELECT *, CASE WHEN NOT is_null AND m_prob > 0 AND u_prob > 0 THEN log2(m_prob / u_prob) END AS w FROM params)"""


Q_MODEL = ", ".join([x.PART, Q_U, Q_PATTERNS, q_em(), q_levels()])


@query("model_params", q_with(Q_MODEL) + f"SELECT field, level, gamma, label, condition, is_null, m_prob, u_prob, {q_round('w', 6)} AS match_weight FROM weights")
def model_params(spark, sf_dir):
    return scoring.model_params(spark, estimated_model(spark, sf_dir)).withColumn("match_weight", rounded(F.col("match_weight"), 6))


@query("match_weight_table", q_with(Q_MODEL) + f"""SELECT 'Prior' AS field, 'Prior' AS label, {q_round(f'log2({x.PRIOR}::DOUBLE / {1 - x.PRIOR}::DOUBLE)', 6)} AS match_weight
  UNION ALL SELECT field, label, {q_round('w', 6)} FROM weights WHERE w IS NOT NULL""")
def match_weight_table(spark, sf_dir):
    return reports.match_weight_table(spark, estimated_model(spark, sf_dir)).withColumn("match_weight", rounded(F.col("match_weight"), 6))


@query("parameter_estimates", q_with(Q_MODEL) + f"""SELECT field, level, label, {q_round('log2(m_prob / (1 - m_prob))', 6)} AS log_odds FROM params
  WHERE NOT is_null AND m_prob > 0 AND m_prob < 1""")
def parameter_estimates(spark, sf_dir):
    return reports.parameter_estimates(spark, estimated_model(spark, sf_dir)).withColumn("log_odds", rounded(F.col("log_odds"), 6))


@query("model_levels", q_with(Q_MODEL) + "SELECT field, level::INT AS level, condition, m_prob, u_prob FROM params")
def model_levels(spark, sf_dir):
    """The levels of a written document, with the values estimated from the records."""
    path = shared_path(spark, "levels")
    models.write_model(spark, estimated_model(spark, sf_dir), path)
    return models.levels_of(spark, path)


@query("score_from_params", q_with(x.RUN1) + f"SELECT {IDS}, match_key, match_weight FROM run1")
def score_from_params(spark, sf_dir):
    """An untrained model is given m and u as rows, written, read back and replayed."""
    model = x.part_model()
    rows = scoring.model_params(spark, model).collect()     # one row per level
    bare = {**model, "comparisons": [{**c, "comparison_levels": [{k: v for k, v in level.items() if k not in ("m_probability", "u_probability")}
                                                                for level in c["comparison_levels"]]} for c in model["comparisons"]]}
    path = shared_path(spark, "params")
    models.write_model(spark, models.stored(models.with_params(bare, rows)), path)
    run = Linker.from_model(x.part_records(spark, sf_dir), models.read_model(spark, path))
    return blocking.unfold(x.score_columns(run.folded())).select(*IDS.split(", "), "match_key", "match_weight")


# ---- whole runs ----------------------------------------------------------------------------------------------------------------

@query("linkage_e2e", with_recursive(x.LINK_RUN) + "SELECT unique_id, source_dataset, name, nation, band, cluster_id FROM link_clusters")
def linkage_e2e(spark, sf_dir):
    """A deterministic run of the whole flow, exported."""
    config = LinkConfig(x.LINK_FIELDS, {"name": True}, "link", "deterministic", composite_rules={"nation+band": True})
    run = Linker(x.link_a(spark, sf_dir), config, x.link_b(spark, sf_dir))
    return run.export().select("unique_id", "source_dataset", "name", "nation", "band", "cluster_id")


@query("linkage_e2e_trained")
def linkage_e2e_trained(spark, sf_dir):
    """A trained run of the whole flow against known truth; checked by properties in the tests."""
    a, b = x.people_tables(spark, sf_dir)
    config = LinkConfig(x.PEOPLE_FIELDS, {"surname": False, "dob": True, "email": True}, "link", "probabilistic",
                        composite_rules={"surname+birth_year": True}, comp_types=x.PEOPLE_TYPES, hyperparams={"max_iterations": 10})
    return Linker(a, config, b).confusion_matrix()
