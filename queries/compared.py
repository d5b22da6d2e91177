"""Two runs side by side."""
from pyspark.sql import functions as F

from kinsift.operators import cluster_metrics, compare, components, demographics, explorer, reports, truth
from kinsift.session import materialise
from queries import fixtures as x
from queries.blocks import FILTER_TOGGLES, Q_FILTERED
from queries.fixtures import q_round, q_with, with_recursive
from queries.metrics import (BINNED, CODED, PERSON_FIELDS, Q_CONFUSION, Q_PERSON_PAIRS, Q_SIZES, q_confusion, q_gammas, q_hist, q_quality,
                             q_snapshot, person_pairs, PERSON_RULES)
from queries.profiles import Q_LABELS
from queries.registry import query

Q_STATUS = """status AS (SELECT coalesce(a.unique_id_l, b.unique_id_l) AS l, coalesce(a.unique_id_r, b.unique_id_r) AS r,
  CASE WHEN a.unique_id_l IS NULL THEN 'added' WHEN b.unique_id_l IS NULL THEN 'removed' ELSE 'shared' END AS category
  FROM run1 a FULL JOIN run2 b ON a.unique_id_l = b.unique_id_l AND a.unique_id_r = b.unique_id_r)"""
Q_DIFF = "SELECT c AS category, count(category) AS n FROM (VALUES ('shared'), ('added'), ('removed')) t(c) LEFT JOIN status ON category = c GROUP BY c"


def both(spark, sf_dir):
    """Two scored runs over one record table."""
    return x.run1(spark, sf_dir), x.run2(spark, sf_dir)


def counted(spark, sf_dir):
    """Both runs, folded, with the number of pairs in each row."""
    return x.counted_run(spark, sf_dir, x.RUN1_RULES), x.counted_run(spark, sf_dir, x.RUN2_RULES)


def stored_runs(spark, sf_dir):
    """Both runs, written once as they are folded."""
    return [materialise(x.folded_run(spark, sf_dir, rules)) for rules in (x.RUN1_RULES, x.RUN2_RULES)]


def folded(spark, sf_dir):
    """Both runs as they are folded, and their records."""
    return *[x.folded_run(spark, sf_dir, rules) for rules in (x.RUN1_RULES, x.RUN2_RULES)], x.part_records(spark, sf_dir)


@query("edge_diff", q_with(x.BOTH_RUNS, Q_STATUS) + Q_DIFF)
def edge_diff(spark, sf_dir):
    return compare.edge_diff(*folded(spark, sf_dir))


@query("edge_status", q_with(x.BOTH_RUNS, Q_STATUS) + "SELECT l AS unique_id_l, r AS unique_id_r, category FROM status")
def edge_status(spark, sf_dir):
    status = compare.folded_status(*folded(spark, sf_dir))
    return compare.edge_status(*both(spark, sf_dir)) if status is None else x.blocking.unfold(status).select(*compare.KEYS, "category")


Q_PROBS = " UNION ALL ".join(f"""SELECT '{name}' AS run, {q_round('avg(match_probability)', 4)} AS mean_match_prob,
  {q_round('median(match_probability)', 4)} AS median_match_prob, count(*) AS n_edges FROM {run}""" for name, run in (("Run 1", "run1"), ("Run 2", "run2")))


@query("prob_comparison", q_with(x.BOTH_RUNS) + Q_PROBS)
def prob_comparison(spark, sf_dir):
    return compare.prob_comparison(*counted(spark, sf_dir))


@query("gamma_comparison", q_with(x.BOTH_RUNS) + f"SELECT 'Run 1' AS run, * FROM ({q_gammas('run1')}) UNION ALL SELECT 'Run 2', * FROM ({q_gammas('run2')})")
def gamma_comparison(spark, sf_dir):
    return compare.gamma_comparison(*counted(spark, sf_dir))


def doc_runs(spark, sf_dir):
    """Clusters of two runs over one narrow record table."""
    records = x.narrow_docs(spark, sf_dir)
    one = components.cluster_records(records, x.blocking.deterministic_links(records, x.DOC_RULES, x.DOC_FIELDS))
    two = components.cluster_records(records, x.blocking.deterministic_links(records, x.DOC_RULES_2, x.DOC_FIELDS_2))
    return one, two


Q_MEMBERS = """m1 AS (SELECT cluster_id, list(unique_id ORDER BY unique_id) AS ids FROM doc_clusters GROUP BY 1),
m2 AS (SELECT cluster_id, list(unique_id ORDER BY unique_id) AS ids FROM doc_clusters2 GROUP BY 1)"""
Q_OVERLAPPED = """SELECT m1.cluster_id AS run1_cluster_id, m2.cluster_id AS run2_cluster_id, len(m1.ids) AS n_run1, len(m2.ids) AS n_run2,
  len(list_intersect(m1.ids, m2.ids)) AS n_shared FROM m1 JOIN m2 """


@query("exact_clusters", with_recursive(x.DOC_RUN, x.DOC_RUN_2, Q_MEMBERS) + Q_OVERLAPPED + "ON m1.cluster_id = m2.cluster_id AND m1.ids = m2.ids")
def exact_clusters(spark, sf_dir):
    return compare.exact_clusters(*doc_runs(spark, sf_dir))


@query("partial_clusters", with_recursive(x.DOC_RUN, x.DOC_RUN_2, Q_MEMBERS) + Q_OVERLAPPED + "ON list_has_any(m1.ids, m2.ids) AND m1.ids <> m2.ids")
def partial_clusters(spark, sf_dir):
    return compare.partial_clusters(*doc_runs(spark, sf_dir))


def _q_dist(name, run, clusters):
    return f"""SELECT '{name}' AS run, 'probability' AS distribution, prob_bin AS bin, n_edges AS n FROM ({q_hist(run)})
  UNION ALL SELECT '{name}', 'cluster_size', k::DOUBLE, count(*) FROM (SELECT cluster_id, count(*) AS k FROM {clusters} GROUP BY 1) GROUP BY k"""


@query("dist_comparison", with_recursive(x.BOTH_RUNS, x.q_components("part_records", "run1", "c1", 0.99), x.q_components("part_records", "run2", "c2", 0.99))
       + _q_dist("Run 1", "run1", "c1") + " UNION ALL " + _q_dist("Run 2", "run2", "c2"))
def dist_comparison(spark, sf_dir):
    one, two = stored_runs(spark, sf_dir)
    records = x.part_records(spark, sf_dir)
    return compare.dist_comparison(x.blocking.weighed(one), x.blocking.weighed(two), components.cluster_pairs(records, one, 0.99), components.cluster_pairs(records, two, 0.99))


Q_INTER = f"""SELECT category || '_edges' AS metric, n::DOUBLE AS value FROM ({Q_DIFF})
UNION ALL SELECT m || CASE run WHEN 'Run 1' THEN '_run1' ELSE '_run2' END, CASE m WHEN 'mean_match_prob' THEN mean_match_prob WHEN 'median_match_prob' THEN median_match_prob ELSE n_edges END
  FROM ({Q_PROBS}), (VALUES ('mean_match_prob'), ('median_match_prob'), ('n_edges')) t(m)
UNION ALL SELECT 'n_exact_matching_clusters', (SELECT count(*) FROM m1 JOIN m2 ON m1.cluster_id = m2.cluster_id AND m1.ids = m2.ids)::DOUBLE
UNION ALL SELECT 'n_partial_matching_clusters', (SELECT count(*) FROM m1 JOIN m2 ON list_has_any(m1.ids, m2.ids) AND m1.ids <> m2.ids)::DOUBLE"""


@query("inter_metrics", with_recursive(x.BOTH_RUNS, Q_STATUS, x.q_components("part_records", "run1", "c1", 0.99), x.q_components("part_records", "run2", "c2", 0.99),
       "m1 AS (SELECT cluster_id, list(unique_id ORDER BY unique_id) AS ids FROM c1 GROUP BY 1)",
       "m2 AS (SELECT cluster_id, list(unique_id ORDER BY unique_id) AS ids FROM c2 GROUP BY 1)") + Q_INTER)
def inter_metrics(spark, sf_dir):
    one, two = [materialise(pairs) for pairs in counted(spark, sf_dir)]
    records = x.part_records(spark, sf_dir)
    return compare.inter_metrics(one, two, components.cluster_pairs(records, one, 0.99), components.cluster_pairs(records, two, 0.99), records)


# ---- toggles inside a run -------------------------------------------------------------------------------------------------

Q_TOGGLED = with_recursive(x.RUN1, Q_FILTERED, x.q_components("part_records", "run1", "c1", 0.99), x.q_components("part_records", "filtered", "c2", 0.99))


def explored(spark, sf_dir):
    """The run read once: covers, counts and forests of its rules."""
    return explorer.RuleExplorer(x.part_records(spark, sf_dir), x.folded_run(spark, sf_dir, x.RUN1_RULES), list(FILTER_TOGGLES), 0.99)


@query("recluster", Q_TOGGLED + "SELECT unique_id, source_dataset, cluster_id FROM c2")
def recluster(spark, sf_dir):
    return explored(spark, sf_dir).clusters(FILTER_TOGGLES).select("unique_id", "source_dataset", "cluster_id")


@query("recluster_delta", Q_TOGGLED + """SELECT 'edges_original' AS metric, count(*) AS value FROM run1 UNION ALL SELECT 'edges_retained', count(*) FROM filtered
  UNION ALL SELECT 'clusters_original', count(DISTINCT cluster_id) FROM c1 UNION ALL SELECT 'clusters_after', count(DISTINCT cluster_id) FROM c2
  UNION ALL SELECT 'edges_removed', (SELECT count(*) FROM run1) - (SELECT count(*) FROM filtered)
  UNION ALL SELECT 'cluster_delta', (SELECT count(DISTINCT cluster_id) FROM c2) - (SELECT count(DISTINCT cluster_id) FROM c1)""")
def recluster_delta(spark, sf_dir):
    return explored(spark, sf_dir).delta(FILTER_TOGGLES)


@query("within_run_toggle", Q_TOGGLED + """SELECT a.unique_id_l, a.unique_id_r, f.effective_rule, CASE WHEN f.unique_id_l IS NULL THEN 'removed' ELSE 'retained' END AS state,
  n.cluster_id AS cluster_after FROM run1 a LEFT JOIN filtered f ON f.unique_id_l = a.unique_id_l AND f.unique_id_r = a.unique_id_r
  JOIN c2 n ON n.unique_id = a.unique_id_l""")
def within_run_toggle(spark, sf_dir):
    """Each original pair with the rule that keeps it, or removed, and the new cluster of its left record."""
    views = explored(spark, sf_dir)
    state = F.when(F.col("effective_rule").isNull(), "removed").otherwise("retained")
    new = views.clusters(FILTER_TOGGLES).selectExpr("unique_id", "source_dataset", "cluster_id AS cluster_after")
    return views.pairs(FILTER_TOGGLES, new).select("unique_id_l", "unique_id_r", "effective_rule", state.alias("state"), "cluster_after")


# ---- demographics of two groups ----------------------------------------------------------------------------------------------

SHIFT_FILTER = "nation IN ('1', '2', '3', '5', '8', '13') AND birth_state <> 'VA'"
Q_TWO_SNAPS = ", ".join([x.PERSON, Q_LABELS, f"chosen AS (SELECT * FROM person_records WHERE {SHIFT_FILTER})",
                         q_snapshot("person_records", CODED + ["gender", "city"], BINNED, "s1"), q_snapshot("chosen", CODED + ["gender", "city"], BINNED, "s2")])
Q_SHIFT = f"""shift AS (SELECT coalesce(a.field, b.field) AS field, coalesce(a.label, b.label) AS label, a.pct AS pct_before, b.pct AS pct_after,
  CASE WHEN a.pct IS NULL THEN 'new' WHEN b.pct IS NULL THEN 'dropped' ELSE 'shared' END AS state, {q_round('b.pct - a.pct', 1)} AS delta
  FROM s1 a FULL JOIN s2 b ON a.field = b.field AND a.label = b.label)"""


def shift(spark, sf_dir):
    people = x.person_records(spark, sf_dir)
    return demographics.demographic_shift(demographics.demographic_snapshot(people), demographics.demographic_snapshot(people.where(SHIFT_FILTER)))


@query("demographic_shift", q_with(Q_TWO_SNAPS, Q_SHIFT) + "SELECT * FROM shift")
def demographic_shift(spark, sf_dir):
    return shift(spark, sf_dir)


@query("comparable_fields", q_with(Q_TWO_SNAPS) + f"""SELECT field, CASE WHEN a.field IS NOT NULL AND b.field IS NOT NULL THEN 'both' WHEN b.field IS NULL THEN 'first' ELSE 'second' END AS found
  FROM (SELECT DISTINCT field FROM s1) a FULL JOIN (SELECT DISTINCT field FROM s2 WHERE field NOT IN ('birth_state', 'gender_code')) b USING (field)""")
def comparable_fields(spark, sf_dir):
    """Known demographic fields that both groups have, or only one of them."""
    people = x.person_records(spark, sf_dir)
    # At most one row per demographic field.
    of = lambda snapshot: [r["field"] for r in snapshot.select("field").distinct().collect()]
    whole = of(demographics.demographic_snapshot(people))
    part = of(demographics.demographic_snapshot(people.where(SHIFT_FILTER)).where("field NOT IN ('birth_state', 'gender_code')"))
    rows = [(f, where) for fields, where in zip(demographics.comparison_fields(whole, part), ("both", "first", "second")) for f in fields]
    return spark.createDataFrame(rows, "field string, found string")


@query("biggest_shift", q_with(Q_TWO_SNAPS, Q_SHIFT) + """SELECT field, label, pct_before, pct_after, delta FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY abs(delta) DESC, label) AS k
  FROM shift WHERE state = 'shared' AND delta <> 0) WHERE k = 1""")
def biggest_shift(spark, sf_dir):
    return demographics.biggest_shift(shift(spark, sf_dir))


QUALITY = ["gender_code", "race_code", "birth_year"]
Q_QUALITY_SHIFT = ", ".join([x.PERSON, Q_LABELS, Q_PERSON_PAIRS, q_quality("person_pairs", QUALITY, "qa"),
                             "some_pairs AS (SELECT * FROM person_pairs WHERE match_key = 0 AND race_code_l <> 'W')", q_quality("some_pairs", QUALITY, "qb"),
                             f"""moved AS (SELECT coalesce(a.field, b.field) AS field, coalesce(a.category, b.category) AS category, coalesce(a.label, b.label) AS label,
  coalesce(a.n_edges, 0) AS n_before, coalesce(b.n_edges, 0) AS n_after, a.avg_match_probability AS prob_before, b.avg_match_probability AS prob_after,
  coalesce({q_round('b.avg_match_probability - a.avg_match_probability', 3)}, 0.0) AS prob_delta FROM qa a FULL JOIN qb b ON a.field = b.field AND a.category = b.category)"""])


def moved(spark, sf_dir):
    pairs = person_pairs(spark, sf_dir)
    return demographics.quality_shift(demographics.edge_quality(pairs, QUALITY, 0.7),
                                      demographics.edge_quality(pairs.where("match_key = 0 and race_code_l <> 'W'"), QUALITY, 0.7))


@query("quality_shift", q_with(Q_QUALITY_SHIFT) + "SELECT * FROM moved")
def quality_shift(spark, sf_dir):
    return moved(spark, sf_dir)


@query("biggest_quality_shift", q_with(Q_QUALITY_SHIFT) + """SELECT field, category, label, n_before, n_after, prob_delta FROM
  (SELECT *, row_number() OVER (PARTITION BY field ORDER BY abs(prob_delta) DESC, category) AS k FROM moved WHERE abs(prob_delta) > 0.001) WHERE k = 1""")
def biggest_quality_shift(spark, sf_dir):
    return demographics.biggest_quality_shift(moved(spark, sf_dir))


Q_PERSON_CLUSTERS = ", ".join([x.PERSON, Q_LABELS, f"det AS ({x.q_deterministic('person_records', PERSON_RULES, ['surname', 'gender'])})",
                               x.q_components("person_records", "det", "pc"), Q_SIZES.format("pc"),
                               "lk AS (SELECT pc.* FROM pc JOIN sizes USING (cluster_id) WHERE n > 1)", "ul AS (SELECT pc.* FROM pc JOIN sizes USING (cluster_id) WHERE n = 1)"])


def person_clusters(spark, sf_dir):
    records = materialise(x.person_records(spark, sf_dir))
    return components.cluster_records(records, x.blocking.deterministic_links(records, PERSON_RULES, ["surname", "gender"]))


@query("linked_unlinked_demographics", with_recursive(Q_PERSON_CLUSTERS, q_snapshot("lk", CODED + ["gender", "city"], BINNED, "s1"),
       q_snapshot("ul", CODED + ["gender", "city"], BINNED, "s2"), Q_SHIFT) + "SELECT * FROM shift")
def linked_unlinked_demographics(spark, sf_dir):
    linked, unlinked = cluster_metrics.linked_unlinked(person_clusters(spark, sf_dir))
    return demographics.demographic_shift(demographics.demographic_snapshot(linked), demographics.demographic_snapshot(unlinked))


# ---- summaries ------------------------------------------------------------------------------------------------------------------

CONFIG1 = {"operation_mode": "dedupe", "linkage_type": "deterministic", "selected_fields": x.DOC_FIELDS, "cluster_threshold": 0.8, "blocking_mode": "OR",
           "blocking_toggles": {"n_chars": True, "n_words+n_lines": True, "lang": False}}
CONFIG2 = {**CONFIG1, "selected_fields": x.DOC_FIELDS_2, "blocking_toggles": {"body": True, "n_chars+n_lines": True}, "cluster_threshold": 0.9}
Q_RESULTS = """r{i} AS (SELECT (SELECT count(*) FROM {pairs}) AS n_edges, (SELECT count(DISTINCT cluster_id) FROM {clusters}) AS n_clusters)"""


def _q_result(column):
    return f"SELECT 'results', '{column}', r1.{column}::VARCHAR, r2.{column}::VARCHAR, (r2.{column} - r1.{column})::DOUBLE FROM r1, r2"


@query("run_diff", with_recursive(x.DOC_RUN, x.DOC_RUN_2, Q_RESULTS.format(i=1, pairs="doc_pairs", clusters="doc_clusters"),
       Q_RESULTS.format(i=2, pairs="doc_pairs2", clusters="doc_clusters2")) + """
SELECT section, key, run1, run2, NULL::DOUBLE AS delta FROM (VALUES ('fields', 'lang', 'no', 'yes'), ('fields', 'n_words', 'yes', 'no'),
  ('blocking_rules', 'body', 'no', 'yes'), ('blocking_rules', 'n_chars+n_lines', 'no', 'yes'), ('blocking_rules', 'n_chars', 'yes', 'no'),
  ('blocking_rules', 'n_words+n_lines', 'yes', 'no'), ('settings', 'cluster_threshold', '0.8', '0.9')) t(section, key, run1, run2)
UNION ALL """ + " UNION ALL ".join(_q_result(c) for c in ("n_edges", "n_clusters")))
def run_diff(spark, sf_dir):
    records = x.narrow_docs(spark, sf_dir)
    results = []
    for rules, fields in ((x.DOC_RULES, x.DOC_FIELDS), (x.DOC_RULES_2, x.DOC_FIELDS_2)):
        pairs = x.blocking.deterministic_pairs(records, rules, fields).agg(F.count("*").alias("n_edges"), F.lit(1).alias("_one"))
        clusters = components.cluster_records(records, x.blocking.deterministic_links(records, rules, fields))
        counted = cluster_metrics.n_clusters(clusters).withColumn("_one", F.lit(1))
        results.append(pairs.join(F.broadcast(counted), "_one").drop("_one"))
    return compare.run_diff(spark, CONFIG1, CONFIG2, *results)


Q_FACTS = """facts AS (SELECT (SELECT count(*) FROM pc) AS n_input_records, (SELECT count(*) FROM det) AS n_edges, (SELECT count(DISTINCT cluster_id) FROM pc) AS n_clusters,
  (SELECT count(*) FROM (SELECT unique_id_l FROM det UNION SELECT unique_id_r FROM det)) AS n_unique_ids_with_edge, 1.0::DOUBLE AS mean_match_prob),
rate AS (SELECT *, floor(100.0::DOUBLE * n_unique_ids_with_edge / n_input_records * 100 + 0.5) / 100 AS linkage_rate FROM facts)"""
CONFIG3 = {"operation_mode": "dedupe", "linkage_type": "deterministic", "selected_fields": ["surname", "gender"], "cluster_threshold": 0.8,
           "blocking_toggles": {"surname+birth_year": True, "first_name+dob": True, "city": False}}


def _q_fact(name):
    return f"SELECT 'results', '{name}', printf('%.4f', {name}::DOUBLE) FROM rate"


@query("run_summary", with_recursive(Q_PERSON_CLUSTERS, Q_FACTS, q_confusion("det", "person_records"), f"cm AS (SELECT {Q_CONFUSION} FROM pr)",
       q_snapshot("pc", CODED + ["gender", "city"], BINNED)) + """
SELECT * FROM (VALUES ('configuration', 'operation_mode', 'dedupe'), ('configuration', 'linkage_type', 'deterministic'), ('configuration', 'blocking_mode', 'OR'),
  ('configuration', 'cluster_threshold', '0.8'), ('configuration', 'comparison_fields', 'surname,gender'),
  ('configuration', 'active_rules', 'first_name+dob,surname+birth_year'), ('configuration', 'disabled_rules', 'city')) t(section, key, value)
UNION ALL """ + " UNION ALL ".join(_q_fact(n) for n in ("n_input_records", "n_edges", "n_clusters", "n_unique_ids_with_edge", "linkage_rate", "mean_match_prob")) + """
UNION ALL """ + " UNION ALL ".join(f"""SELECT 'accuracy', '{n}', printf('%.4f', "{n}") FROM cm""" for n in ("precision", "recall", "f1", "fdr", "fnr")) + """
UNION ALL SELECT 'demographics', field || '#' || k::VARCHAR, label || ': ' || n_records::VARCHAR || ' (' || printf('%.1f', pct) || '%)'
  FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n_records DESC, value) AS k FROM snap) WHERE k <= 3""")
def run_summary(spark, sf_dir):
    clusters = person_clusters(spark, sf_dir)
    records = clusters.drop("cluster_id")
    pairs = materialise(x.blocking.deterministic_pairs(records, PERSON_RULES, ["surname", "gender"]))
    return reports.run_summary(spark, CONFIG3, pairs, clusters, truth.confusion_matrix(pairs, records))
