"""Candidate pairs, counts without pairs, explorer views."""
from pyspark.sql import functions as F

from kinsift.operators import blocking, edge_metrics, explorer, perturb
from queries import fixtures as x
from queries.fixtures import q_draw, q_node, q_pairs, q_rule, q_with, with_recursive
from queries.registry import query

IDS = "unique_id_l, unique_id_r, source_dataset_l, source_dataset_r"


def docs(spark, sf_dir):
    return x.narrow_docs(spark, sf_dir)


@query("block_single", q_with(x.DOC) + q_pairs("doc_records", [["n_chars"]], ["lang"]))
def block_single(spark, sf_dir):
    return blocking.candidate_pairs(docs(spark, sf_dir), [["n_chars"]], ["lang"])


@query("block_composite", q_with(x.DOC) + q_pairs("doc_records", [["n_words", "n_lines", "lang"]], ["source"]))
def block_composite(spark, sf_dir):
    return blocking.candidate_pairs(docs(spark, sf_dir), [["n_words", "n_lines", "lang"]], ["source"])


OR_RULES = [["n_chars"], ["n_words", "n_lines"], ["body"]]


@query("block_or", q_with(x.DOC) + q_pairs("doc_records", OR_RULES, ["lang"]))
def block_or(spark, sf_dir):
    return blocking.candidate_pairs(docs(spark, sf_dir), OR_RULES, ["lang"])


@query("block_and", q_with(x.DOC) + q_pairs("doc_records", [["n_lines", "lang", "n_words", "source"]], []))
def block_and(spark, sf_dir):
    toggles = {"n_lines": True, "body": False, "lang+n_words": True, "source+lang": True}
    return blocking.candidate_pairs(docs(spark, sf_dir), blocking.rules_from_toggles(toggles, "AND"), [])


@query("block_link", q_with(x.LINK) + q_pairs("link_a", x.LINK_RULES, x.LINK_FIELDS, "link_b"))
def block_link(spark, sf_dir):
    return blocking.candidate_pairs(x.link_a(spark, sf_dir), x.LINK_RULES, x.LINK_FIELDS, x.link_b(spark, sf_dir))


HOT_RULES = [["brand", "size"], ["name", "size"]]


@query("block_hot_tiles", q_with(x.PART) + q_pairs("part_records", HOT_RULES, ["type"]))
def block_hot_tiles(spark, sf_dir):
    """The same pairs when blocks over four records are cut into tiles."""
    return blocking.candidate_pairs(x.part_records(spark, sf_dir), HOT_RULES, ["type"], hot_block=4)


@query("deterministic_link", q_with(x.DOC) + x.q_deterministic("doc_records", x.DOC_RULES, x.DOC_FIELDS))
def deterministic_link(spark, sf_dir):
    return x.doc_pairs(spark, sf_dir)


@query("deterministic_link_ab", q_with(x.LINK) + x.q_deterministic("link_a", x.LINK_RULES, x.LINK_FIELDS, "link_b"))
def deterministic_link_ab(spark, sf_dir):
    return blocking.deterministic_pairs(x.link_a(spark, sf_dir), x.LINK_RULES, x.LINK_FIELDS, x.link_b(spark, sf_dir))


# ---- counts ------------------------------------------------------------------------------------------------------------

COUNT_RULES = [["brand"], ["name", "type"], ["size"]]


@query("candidate_count", q_with(x.PART) + f"""SELECT 'or' AS mode, count(*) AS n_pairs FROM ({q_pairs('part_records', COUNT_RULES, [])})
  UNION ALL SELECT 'and', count(*) FROM ({q_pairs('part_records', [['brand', 'name', 'type', 'size']], [])})
  UNION ALL SELECT 'single', count(*) FROM ({q_pairs('part_records', [['brand']], [])})""")
def candidate_count(spark, sf_dir):
    parts = x.part_records(spark, sf_dir)
    count = lambda mode, rules: blocking.candidate_count(parts, rules).select(F.lit(mode).alias("mode"), "n_pairs")
    return (count("or", COUNT_RULES).unionByName(count("and", [["brand", "name", "type", "size"]]))
            .unionByName(count("single", [["brand"]])))


@query("candidate_count_link", q_with(x.LINK) + f"SELECT count(*) AS n_pairs FROM ({q_pairs('link_a', [['nation'], ['band'], ['name']], [], 'link_b')})")
def candidate_count_link(spark, sf_dir):
    return blocking.candidate_count(x.link_a(spark, sf_dir), [["nation"], ["band"], ["name"]], x.link_b(spark, sf_dir))


def _q_estimate(i, rule):
    key = ", ".join(rule)
    there = " AND ".join(f"{f} IS NOT NULL" for f in rule)
    return f"""SELECT {i}::INT AS rule_index, '{'+'.join(rule)}' AS rule, count(*) AS n_unique, max(n) AS largest_block,
  ((SELECT count(*) FROM part_records) * (SELECT count(*) FROM part_records) // count(*))::BIGINT AS estimate
  FROM (SELECT {key}, count(*) AS n FROM part_records WHERE {there} GROUP BY {key})"""


ESTIMATE_RULES = [["brand"], ["type"], ["name", "type"], ["type", "size"]]


@query("candidate_estimate", q_with(x.PART, "est AS (" + " UNION ALL ".join(_q_estimate(i, r) for i, r in enumerate(ESTIMATE_RULES)) + ")")
       + "SELECT *, CASE WHEN estimate > 5000000 THEN 'danger' WHEN estimate > 500000 THEN 'warning' ELSE 'ok' END AS verdict FROM est")
def candidate_estimate(spark, sf_dir):
    return blocking.estimate_per_rule(x.part_records(spark, sf_dir), ESTIMATE_RULES)


def q_pattern(fields):
    flags = [f"coalesce(a.{f} = b.{f}, false) AS covers_{f}" for f in fields]
    return (f"SELECT *, count(*) AS n_pairs FROM (SELECT {', '.join(flags)} FROM part_records a JOIN part_records b ON {q_node('a')} < {q_node('b')}) "
            f"WHERE {' OR '.join('covers_' + f for f in fields)} GROUP BY ALL")


@query("agreement_patterns", q_with(x.PART) + q_pattern(x.PART_FIELDS))
def agreement_patterns(spark, sf_dir):
    """Agreement of all record pairs at once, from group sizes."""
    return blocking.agreement_patterns(x.part_records(spark, sf_dir), x.PART_FIELDS)


# ---- thirteen fields: 8191 sets of fields, twelve rules of one field each ---------------------------------------------------

WIDE = {"colour": ("split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 1)"), "thing": ("split_part(p_name, ' ', 2)", "split_part(p_name, ' ', 2)"),
        "name": ("p_name", "p_name"), "brand": ("p_brand", "p_brand"), "digit": ("right(p_brand, 1)", "right(p_brand, 1)"), "type": ("p_type", "p_type"),
        "initial": ("left(p_type, 1)", "left(p_type, 1)"), "size": ("p_size", "p_size"), "tens": ("p_size div 10", "p_size // 10"),
        "band": ("cast(floor(p_retailprice / 10) as bigint)", "floor(p_retailprice / 10)::BIGINT"),
        "price": ("cast(floor(p_retailprice) as bigint)", "floor(p_retailprice)::BIGINT"), "odd": ("p_size % 2", "p_size % 2"),
        "long": ("CASE WHEN p_size % 7 <> 0 THEN length(p_name) END", "CASE WHEN p_size % 7 <> 0 THEN length(p_name) END")}
Q_WIDE = "wide AS (SELECT p_partkey::VARCHAR AS unique_id, 'A' AS source_dataset, " + ", ".join(f"{sql} AS {f}" for f, (_, sql) in WIDE.items()) + " FROM part)"


def wide_records(spark, sf_dir):
    return x.load(spark, sf_dir, "part").selectExpr("cast(p_partkey as string) AS unique_id", "'A' AS source_dataset", *[f"{e} AS {f}" for f, (e, _) in WIDE.items()])


@query("agreement_patterns_wide", q_with(Q_WIDE) + "SELECT *, count(*) AS n_pairs FROM (SELECT " + ", ".join(f"coalesce(a.{f} = b.{f}, false) AS covers_{f}" for f in WIDE)
       + " FROM wide a JOIN wide b ON a.unique_id < b.unique_id) WHERE " + " OR ".join(f"covers_{f}" for f in WIDE) + " GROUP BY ALL")
def agreement_patterns_wide(spark, sf_dir):
    """Agreement of all record pairs on any of 8191 sets of fields."""
    return blocking.agreement_patterns(wide_records(spark, sf_dir), list(WIDE))


ANY_FIELD = [[f] for f in WIDE if f != "odd"]


@query("candidate_count_any_field", q_with(Q_WIDE) + "SELECT count(*) AS n_pairs FROM wide a JOIN wide b ON a.unique_id < b.unique_id WHERE "
       + " OR ".join(f"a.{f} = b.{f}" for (f,) in ANY_FIELD))
def candidate_count_any_field(spark, sf_dir):
    """Preflight of twelve rules of one field each."""
    return blocking.candidate_count(wide_records(spark, sf_dir), ANY_FIELD)


def q_rule_counts(rules):
    names = ", ".join(f"({i}::INT, '{blocking.rule_sql(r)}')" for i, r in enumerate(rules))
    return (f"SELECT rule_index, rule_sql, count(*) AS n FROM ({q_pairs('part_records', rules, [])}) "
            f"JOIN (VALUES {names}) t(rule_index, rule_sql) ON rule_index = match_key GROUP BY ALL")


@query("blocking_counts", q_with(x.PART) + q_rule_counts(COUNT_RULES))
def blocking_counts(spark, sf_dir):
    """Pairs per rule without making them."""
    return blocking.rule_counts(x.part_records(spark, sf_dir), COUNT_RULES)


@query("blocking_counts_of_run", q_with(x.RUN1, "names(rule_index, rule_sql) AS (VALUES " + ", ".join(
    f"({i}::INT, '{blocking.rule_sql(r)}')" for i, r in enumerate(x.RUN1_RULES)) + ")")
    + "SELECT match_key AS rule_index, rule_sql, count(*) AS n FROM run1 JOIN names ON rule_index = match_key GROUP BY ALL")
def blocking_counts_of_run(spark, sf_dir):
    return blocking.named_rules(edge_metrics.blocking_counts(x.counted_run(spark, sf_dir)), x.RUN1_RULES)


@query("cumulative_blocking", q_with(x.PART, f"c AS ({q_rule_counts(COUNT_RULES)})")
       + "SELECT *, (sum(n) OVER (ORDER BY rule_index ROWS UNBOUNDED PRECEDING))::BIGINT AS cumulative_n FROM c")
def cumulative_blocking(spark, sf_dir):
    return blocking.cumulative(blocking.rule_counts(x.part_records(spark, sf_dir), COUNT_RULES))


REDUNDANT = ["brand", "brand+size", "name+type"]


@query("redundant_rules", q_with(x.PART, f"p AS ({q_pairs('part_records', [['brand'], ['name', 'type']], ['size'])})") + """
SELECT 'brand+size' AS rule, 'brand' AS implied_by, count(*) FILTER (brand_l = brand_r AND size_l = size_r) AS n_pairs,
  count(*) FILTER (brand_l = brand_r AND size_l = size_r AND NOT coalesce(brand_l = brand_r, false)) AS n_added, true AS redundant FROM p
UNION ALL SELECT 'name+type', '', count(*) FILTER (name_l = name_r AND type_l = type_r),
  count(*) FILTER (name_l = name_r AND type_l = type_r AND NOT coalesce(brand_l = brand_r, false)), false FROM p""")
def redundant_rules(spark, sf_dir):
    patterns = blocking.agreement_patterns(x.part_records(spark, sf_dir), x.PART_FIELDS)
    return explorer.redundant_rules(patterns, REDUNDANT)


# ---- truth -------------------------------------------------------------------------------------------------------------

def _q_truth(view, extra=""):
    return f"""SELECT a.unique_id AS unique_id_l, a.source_dataset AS source_dataset_l, b.unique_id AS unique_id_r, b.source_dataset AS source_dataset_r,
  1.0::DOUBLE AS clerical_match_score FROM {view} a JOIN {view} b ON a.cluster = b.cluster WHERE {q_node('a')} < {q_node('b')}{extra}"""


@query("gt_edges_dedupe", q_with(x.DOC) + _q_truth("doc_records"))
def gt_edges_dedupe(spark, sf_dir):
    return blocking.truth_pairs(docs(spark, sf_dir))


@query("gt_edges_link", q_with(x.LINK_ALL) + _q_truth("link_all", " AND a.source_dataset <> b.source_dataset"))
def gt_edges_link(spark, sf_dir):
    return blocking.truth_pairs(x.link_a(spark, sf_dir).unionByName(x.link_b(spark, sf_dir)), link=True)


@query("gt_edge_count", q_with(x.DOC, x.LINK_ALL) + f"""SELECT 'dedupe' AS mode, count(*) AS n_gt_edges FROM ({_q_truth('doc_records')})
  UNION ALL SELECT 'link', count(*) FROM ({_q_truth('link_all', ' AND a.source_dataset <> b.source_dataset')})""")
def gt_edge_count(spark, sf_dir):
    both = x.link_a(spark, sf_dir).unionByName(x.link_b(spark, sf_dir))
    return (blocking.truth_pair_count(docs(spark, sf_dir)).select(F.lit("dedupe").alias("mode"), "n_gt_edges")
            .unionByName(blocking.truth_pair_count(both, True).select(F.lit("link").alias("mode"), "n_gt_edges")))


# ---- explorer ----------------------------------------------------------------------------------------------------------

TOGGLES = {"brand": False, "name+type": True, "size": True, "colour": True}
EXPLORED = ["brand", "size", "name+type"]


def q_covers(key):
    return "(" + " AND ".join(f"coalesce({f}_l = {f}_r, false)" for f in key.split("+")) + ")"


@query("coverage_matrix", q_with(x.RUN1) + f"""SELECT {IDS}, match_key, match_probability, match_weight, {q_covers('brand')} AS covers_brand,
  {q_covers('size')} AS covers_size, {q_covers('name')} AS covers_name, false AS covers_colour FROM run1""")
def coverage_matrix(spark, sf_dir):
    return explorer.coverage_matrix(x.run1(spark, sf_dir), ["brand", "size", "name", "colour"])


@query("composite_cover", q_with(x.RUN1) + f"""SELECT {IDS}, match_key, match_probability, match_weight, {q_covers('brand+type')} AS "covers_brand+type",
  false AS "covers_brand+colour" FROM run1""")
def composite_cover(spark, sf_dir):
    return explorer.coverage_matrix(x.run1(spark, sf_dir), ["brand+type", "brand+colour"])


Q_FILTERED = f"""filtered AS (SELECT *, CASE WHEN {q_covers('name+type')} THEN 'name+type' WHEN {q_covers('brand')} THEN 'brand' END AS effective_rule
  FROM run1 WHERE {q_covers('name+type')} OR {q_covers('brand')})"""
FILTER_TOGGLES = {"size": False, "name+type": True, "brand": True}


@query("filter_by_rules", q_with(x.RUN1, Q_FILTERED) + f"SELECT {IDS}, match_key, match_probability, match_weight, effective_rule FROM filtered")
def filter_by_rules(spark, sf_dir):
    kept = explorer.filter_by_rules(x.run1(spark, sf_dir), FILTER_TOGGLES)
    return kept.select(*IDS.split(", "), "match_key", "match_probability", "match_weight", "effective_rule")


@query("pair_preview", q_with(x.RUN1, Q_FILTERED) + f"""SELECT {IDS}, effective_rule, match_probability, match_weight, gamma_name, gamma_brand, gamma_type, gamma_size
  FROM filtered ORDER BY source_dataset_l, unique_id_l, source_dataset_r, unique_id_r LIMIT 200""")
def pair_preview(spark, sf_dir):
    return explorer.pair_preview(explorer.filter_by_rules(x.run1(spark, sf_dir), FILTER_TOGGLES))


Q_EXPLORED = f"""seen AS (SELECT {', '.join(q_covers(f) + ' AS c_' + f for f in x.PART_FIELDS)} FROM run1)"""


@query("cascade_order", q_with(x.RUN1, Q_EXPLORED) + """SELECT 'brand' AS rule, 0::INT AS position, count(*) FILTER (c_brand) AS n_pairs FROM seen
  UNION ALL SELECT 'size', 1, count(*) FILTER (c_size) FROM seen UNION ALL SELECT 'name+type', 2, count(*) FILTER (c_name AND c_type) FROM seen""")
def cascade_order(spark, sf_dir):
    return explorer.cascade_order(explorer.coverage_patterns(x.counted_run(spark, sf_dir), x.PART_FIELDS), EXPLORED)


Q_WATER = Q_EXPLORED + """, w AS (SELECT CASE WHEN c_size THEN 'size' WHEN c_brand THEN 'brand' WHEN c_name AND c_type THEN 'name+type' END AS every,
  CASE WHEN c_brand THEN 'brand' WHEN c_name AND c_type THEN 'name+type' END AS active FROM seen),
steps AS (SELECT p::INT AS position, r AS rule, count(*) FILTER (every = r) AS all_active, count(*) FILTER (active = r) AS active_only
  FROM w, (VALUES (0, 'size'), (1, 'brand'), (2, 'name+type')) t(p, r) GROUP BY p, r)"""


@query("blocking_waterfall", q_with(x.RUN1, Q_WATER) + """SELECT *, all_active - active_only AS lost FROM steps
  UNION ALL SELECT 3, 'TOTAL', sum(all_active)::BIGINT, sum(active_only)::BIGINT, sum(all_active - active_only)::BIGINT FROM steps""")
def blocking_waterfall(spark, sf_dir):
    patterns = explorer.coverage_patterns(x.counted_run(spark, sf_dir), x.PART_FIELDS)
    return explorer.blocking_waterfall(patterns, ["size", "brand", "name+type"], {"brand": True, "name+type": True})


@query("explorer_stats", q_with(x.RUN1, Q_EXPLORED) + f"""SELECT count(*) AS n_original, count(*) FILTER (c_brand OR (c_name AND c_type)) AS n_filtered,
  {x.q_round('100.0::DOUBLE * (1.0::DOUBLE - count(*) FILTER (c_brand OR (c_name AND c_type))::DOUBLE / count(*))', 1)} AS reduction_pct, 2::INT AS n_rules_enabled FROM seen""")
def explorer_stats(spark, sf_dir):
    patterns = explorer.coverage_patterns(x.counted_run(spark, sf_dir), x.PART_FIELDS)
    return explorer.explorer_stats(patterns, EXPLORED, {"brand": True, "name+type": True})


@query("cohort_from_edges", q_with(x.RUN1, Q_FILTERED) + """SELECT p.* FROM part_records p WHERE EXISTS (SELECT 1 FROM filtered f
  WHERE (f.unique_id_l = p.unique_id AND f.source_dataset_l = p.source_dataset) OR (f.unique_id_r = p.unique_id AND f.source_dataset_r = p.source_dataset))""")
def cohort_from_edges(spark, sf_dir):
    kept = explorer.filter_by_rules(x.counted_run(spark, sf_dir), FILTER_TOGGLES)
    return explorer.touched_records(x.part_records(spark, sf_dir), kept)


@query("lookup_enrich", q_with(x.PERSON) + f""", listed AS (SELECT s_nationkey::VARCHAR AS k, s_name, row_number() OVER (PARTITION BY s_nationkey
  ORDER BY substr(md5(s_name), 1, 2), s_name) AS pos, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
rows_ AS (SELECT p.unique_id, p.nation, {q_draw('supplier', 'p.unique_id')} % (SELECT max(n) FROM listed WHERE k = p.nation) + 1 AS want FROM person_records p)
SELECT unique_id, nation, s_name AS supplier FROM rows_ LEFT JOIN listed ON k = nation AND pos = want""")
def lookup_enrich(spark, sf_dir):
    dimension = x.load(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("nation_key"), "s_name")
    people = x.person_records(spark, sf_dir).select("unique_id", "nation")
    return perturb.lookup_enrich(people, "nation", dimension, "nation_key", "s_name", "supplier")
