"""Hand-made tables and properties of blocking, training, scoring, clustering and accuracy."""
import itertools
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinsift.functions import similarity
from kinsift.operators import blocking, compare, components, edge_metrics, explorer, reports, scoring, training, truth, value_join
from kinsift.operators.comparators import build_comparisons, register_comparator, with_gammas
from kinsift.plans.linker import LinkConfig, Linker
from kinsift.sources import models, rules


def table(spark, rows, columns, source="A"):
    schema = ", ".join(f"{c} string" for c in ["unique_id"] + columns)
    return spark.createDataFrame([tuple(r) for r in rows], schema).withColumn("source_dataset", F.lit(source))


@pytest.fixture(scope="module")
def five(spark):
    return table(spark, [("1", "ann", "x"), ("2", "ann", "x"), ("3", "bob", "x"), ("4", "ann", None), ("5", None, None)],
                 ["name", "city"])


def pair_set(df, *more):
    return {tuple(r) for r in df.select("unique_id_l", "unique_id_r", *more).collect()}


def test_or_mode_gives_each_pair_its_first_rule(five):
    pairs = blocking.candidate_pairs(five, [["name"], ["city"]], ["name", "city"])
    assert pair_set(pairs, "match_key") == {("1", "2", 0), ("1", "4", 0), ("2", "4", 0), ("1", "3", 1), ("2", "3", 1)}


def test_and_mode(five):
    rules = blocking.rules_from_toggles({"name": True, "city": True}, "AND")
    assert rules == [["name", "city"]]
    assert pair_set(blocking.candidate_pairs(five, rules, [])) == {("1", "2")}


def test_no_rule_is_an_error():
    with pytest.raises(ValueError):
        blocking.rules_from_toggles({"name": False})


def test_deterministic_needs_two_fields(five):
    pairs = blocking.deterministic_pairs(five, [["name"], ["city"]], ["name", "city"])
    assert pair_set(pairs) == {("1", "2")}
    row = pairs.first()
    assert (row["match_probability"], row["match_weight"]) == (1.0, 100.0)


def random_records(spark, n, seed, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])
        rows.append((str(i), name, rng.choice(["x", "y", "z", None]), rng.choice(["1", "2", "3", "4", None])))
    return rows


def brute(rows, rules, fields=("name", "city", "size")):
    at = {f: i + 1 for i, f in enumerate(fields)}
    out = {}
    for l, r in itertools.combinations(rows, 2):
        l, r = (l, r) if f"A-{l[0]}" < f"A-{r[0]}" else (r, l)
        for k, rule in enumerate(rules):
            if all(l[at[f]] is not None and l[at[f]] == r[at[f]] for f in rule):
                out[(l[0], r[0])] = k
                break
    return out


RULES = [["name", "city"], ["size"], ["name"]]


@pytest.mark.parametrize("hot_block", [None, 3, 10, 50_000])
def test_pairs_equal_brute_force_with_a_hot_value(spark, hot_block):
    rows = random_records(spark, 120, 7)
    df = table(spark, rows, ["name", "city", "size"])
    found = blocking.candidate_pairs(df, RULES, ["name"], hot_block=hot_block)
    listed = [tuple(r) for r in found.select("unique_id_l", "unique_id_r", "match_key").collect()]
    assert len(listed) == len(set(listed))
    assert {(l, r): k for l, r, k in listed} == brute(rows, RULES)


@pytest.mark.parametrize("hot_block", [None, 4, 50_000])
def test_link_pairs_with_tiles(spark, hot_block):
    rows_a, rows_b = random_records(spark, 60, 1), random_records(spark, 50, 2)
    a = table(spark, rows_a, ["name", "city", "size"])
    b = table(spark, rows_b, ["name", "city", "size"], "B")
    found = blocking.candidate_pairs(a, [["name"], ["city", "size"]], [], b, hot_block=hot_block)
    expected = {(l[0], r[0]) for l in rows_a for r in rows_b
                if (l[1] and l[1] == r[1]) or (l[2] and l[3] and l[2] == r[2] and l[3] == r[3])}
    listed = [tuple(r) for r in found.select("unique_id_l", "unique_id_r").collect()]
    assert len(listed) == len(set(listed)) and set(listed) == expected


def test_counts_without_pairs(spark):
    rows = random_records(spark, 150, 3)
    df = table(spark, rows, ["name", "city", "size"])
    expected = brute(rows, RULES)
    assert blocking.candidate_count(df, RULES).first()["n_pairs"] == len(expected)
    per_rule = {r["rule_index"]: r["n"] for r in blocking.rule_counts(df, RULES).collect()}
    assert per_rule == {k: list(expected.values()).count(k) for k in set(expected.values())}
    patterns = blocking.agreement_patterns(df, ["name", "city", "size"])
    assert patterns.agg(F.sum("n_pairs")).first()[0] == len(brute(rows, [["name"], ["city"], ["size"]]))


def test_sharpened_rules_find_the_same_deterministic_pairs(spark):
    rows = random_records(spark, 100, 5)
    df = table(spark, rows, ["name", "city", "size"])
    fields = ["name", "city", "size"]
    plain = blocking.candidate_pairs(df, [["name"]], fields).where(blocking.agreement_count(fields) >= 2)
    assert pair_set(blocking.deterministic_pairs(df, [["name"]], fields)) == pair_set(plain)


def test_star_clusters_equal_pair_clusters(spark):
    rows = random_records(spark, 90, 11, hot=0.33)
    df = table(spark, rows, ["name", "city", "size"])
    rules, fields = [["name"], ["size"]], ["name", "city", "size"]
    by_pairs = components.cluster_pairs(df, blocking.deterministic_pairs(df, rules, fields))
    by_stars = components.cluster_records(df, blocking.deterministic_links(df, rules, fields))
    ids = lambda c: {tuple(r) for r in c.select("unique_id", "cluster_id").collect()}
    assert ids(by_pairs) == ids(by_stars)


# ---- components ------------------------------------------------------------------------------------------------

def clusters_of(spark, edges, n, **more):
    nodes = table(spark, [(str(i),) for i in range(n)], [])
    pairs = spark.createDataFrame([(str(a), str(b), p) for a, b, p in edges], "unique_id_l string, unique_id_r string, match_probability double")
    pairs = pairs.withColumn("source_dataset_l", F.lit("A")).withColumn("source_dataset_r", F.lit("A"))
    out = {}
    for r in components.cluster_records(nodes, components.edges_of(pairs, 0.8), **more).collect():
        out.setdefault(r["cluster_id"], set()).add(int(r["unique_id"]))
    return sorted(map(sorted, out.values()))


def test_threshold_is_inclusive_and_singletons_stay(spark):
    edges = [(1, 2, 0.95), (2, 3, 0.85), (4, 5, 0.70), (6, 7, 0.80)]
    assert clusters_of(spark, edges, 9) == [[0], [1, 2, 3], [4], [5], [6, 7], [8]]


def test_no_edges(spark):
    assert clusters_of(spark, [], 0 + 3) == [[0], [1], [2]]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80), 0.9) for _ in range(55)] + [(i, i + 1, 0.9) for i in range(80, 110)]
    edges += [(79, i, 0.9) for i in range(111, 130)]        # a hub
    parent = list(range(130))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in edges:
        parent[find(a)] = find(b)
    groups = {}
    for i in range(130):
        groups.setdefault(find(i), []).append(i)
    rng.shuffle(edges)
    assert clusters_of(spark, edges, 130, hot_node=5) == sorted(map(sorted, groups.values()))


# ---- similarity and comparators ----------------------------------------------------------------------------------

def test_known_similarities(spark):
    df = spark.createDataFrame([("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("", ""), (None, "a"), ("ab", "ba"), ("abc", "abc")], "a string, b string")
    rows = df.select(similarity.jaro_winkler_similarity("a", "b").alias("jw"), similarity.jaro_similarity("a", "b").alias("j"),
                     similarity.damerau_levenshtein("a", "b").alias("d")).collect()
    assert [round(r["jw"], 4) for r in rows[:3]] == [0.9611, 0.8133, 0.0]
    assert round(rows[0]["j"], 4) == 0.9444
    assert rows[3]["jw"] is None and rows[3]["d"] is None
    assert rows[4]["d"] == 1 and rows[5]["jw"] == 1.0


def test_similarities_equal_an_independent_engine(spark):
    import duckdb

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 9)))
    pairs = [(word(), word()) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", similarity.jaro_winkler_similarity("a", "b"), similarity.jaro_similarity("a", "b"), similarity.damerau_levenshtein("a", "b"))
    con = duckdb.connect()
    for a, b, jw, j, d in df.collect():
        want = con.execute("select jaro_winkler_similarity(?, ?), jaro_similarity(?, ?), damerau_levenshtein(?, ?)", [a, b] * 3).fetchone()
        assert abs(jw - want[0]) < 1e-9 and abs(j - want[1]) < 1e-9 and d == want[2], (a, b)


def test_comparator_choice():
    chosen = build_comparisons(["first_name", "dob", "city", "note"], {"note": "LevenshteinAtThresholds", "city": "NoSuchThing"})
    sizes = {c["output_column_name"]: len(c["comparison_levels"]) for c in chosen}
    assert sizes == {"first_name": 6, "dob": 7, "city": 3, "note": 5}
    as_coded = build_comparisons(["surname"], {"surname": "JaroAtThresholds"}, as_coded=True)
    assert len(as_coded[0]["comparison_levels"]) == 3


def test_registered_comparator(spark):
    register_comparator("SameLength", lambda f: [
        {"sql_condition": f'"{f}_l" IS NULL', "is_null_level": True}, {"sql_condition": f'length("{f}_l") = length("{f}_r")'}, {"sql_condition": "ELSE"}])
    df = spark.createDataFrame([("ab", "cd"), ("a", "cd"), (None, "x")], "w_l string, w_r string")
    assert [r["gamma_w"] for r in with_gammas(df, build_comparisons(["w"], {"w": "SameLength"})).collect()] == [1, 0, -1]


def test_date_of_birth_ladder(spark):
    rows = [("1980-01-01", "1980-01-01"), ("1980-01-01", "1980-01-10"), ("1980-01-12", "1980-01-21"), ("1980-01-01", "1980-01-29"),
            ("1980-01-01", "1980-11-29"), ("1980-01-01", "1986-12-29"), ("1980-01-01", "2006-12-29"), ("1980-01-01", "soon"), (None, None)]
    df = spark.createDataFrame(rows, "dob_l string, dob_r string")
    assert [r["gamma_dob"] for r in with_gammas(df, build_comparisons(["dob"])).collect()] == [5, 4, 4, 3, 2, 1, 0, -1, -1]


# ---- scoring and training ------------------------------------------------------------------------------------------

def small_model(fields=("name", "city", "size")):
    comparisons = build_comparisons(list(fields))
    for c, (m, u) in zip(comparisons, [(0.9, 0.1), (0.8, 0.25), (0.7, 0.3)]):
        for level, pair in zip(c["comparison_levels"][1:], [(m, u), (1 - m, 1 - u)]):
            level["m_probability"], level["u_probability"] = pair
    return {"comparisons": comparisons, "probability_two_random_records_match": 0.05}


@pytest.mark.parametrize("threshold", [-5.0, -1.0, 0.5, 3.0, 50.0])
def test_pruned_scoring_loses_nothing(spark, threshold):
    df = table(spark, random_records(spark, 80, 13), ["name", "city", "size"])
    model = small_model()
    every = scoring.predict(df, RULES, model, threshold=None)
    wanted = {(r[0], r[1], round(r[2], 9)) for r in every.where(F.col("match_weight") >= threshold).select("unique_id_l", "unique_id_r", "match_weight").collect()}
    got = scoring.predict(df, RULES, model, threshold=threshold)
    assert {(r[0], r[1], round(r[2], 9)) for r in got.select("unique_id_l", "unique_id_r", "match_weight").collect()} == wanted


def test_probability_of_extreme_weights(spark):
    row = spark.range(1).select(scoring.probability(F.lit(5000.0)).alias("hi"), scoring.probability(F.lit(-5000.0)).alias("lo"), scoring.probability(F.lit(0.0)).alias("mid")).first()
    assert row["hi"] == 1.0 and row["mid"] == 0.5 and 0 <= row["lo"] < 1e-200


def test_training_field_order():
    assert training.rank_training_fields(["zz", "dob", "surname"], {"zz": False}) == ["surname", "dob", "zz"]
    assert training.rank_training_fields(["zz", "dob", "surname"], {"zz": True, "surname+dob": True}) == ["zz"]


def test_pattern_counts_equal_pair_counts(spark):
    df = table(spark, random_records(spark, 100, 17), ["name", "city", "size"])
    comparisons = build_comparisons(["city", "size"], {"city": "LevenshteinAtThresholds"})
    folded = training.pattern_counts(df, ["name"], comparisons)
    pairs = with_gammas(blocking.candidate_pairs(df, [["name"]], ["city", "size"]), comparisons).groupBy("gamma_city", "gamma_size").agg(F.count("*").alias("n"))
    rows = lambda d: {tuple(r) for r in d.select("gamma_city", "gamma_size", "n").collect()}
    assert rows(folded) == rows(pairs)


def test_em_raises_likelihood(spark):
    import math

    df = table(spark, random_records(spark, 150, 19), ["name", "city", "size"])
    comparisons = build_comparisons(["city", "size"])
    patterns = training.pattern_counts(df, ["name"], comparisons)
    m = {c["output_column_name"]: training.starting_m(c) for c in comparisons}
    u = {"city": {1: 0.3, 0: 0.7}, "size": {1: 0.25, 0: 0.75}}
    rows = patterns.collect()

    def likelihood(m, prior):
        total = 0.0
        for r in rows:
            a, b = prior, 1 - prior
            for f in m:
                if r[f"gamma_{f}"] >= 0:
                    a, b = a * m[f][r[f"gamma_{f}"]], b * u[f][r[f"gamma_{f}"]]
            total += r["n"] * math.log(a + b)
        return total

    last = likelihood(m, 0.1)
    for rounds in (1, 2, 5):
        trained, prior, _ = training.em_train(patterns, m, u, 0.1, rounds, 0.0)
        now = likelihood(trained, prior)
        assert now >= last - 1e-9
        last = now
        for levels in trained.values():
            assert abs(sum(levels.values()) - 1.0) < 1e-6


def test_unseen_level_keeps_its_start(spark):
    patterns = spark.createDataFrame([(1, 10), (-1, 4)], "gamma_x int, n long")
    m, _, unseen = training.em_train(patterns, {"x": {1: 0.9, 0: 0.1}}, {"x": {1: 0.5, 0: 0.5}}, 0.2, 3)
    assert ("x", 0) in unseen and m["x"][0] == 0.1


def test_merge_is_a_mean():
    assert training.merge_sessions([{"a": {1: 0.8}}, {"a": {1: 0.6}, "b": {0: 0.5}}]) == {"a": {1: pytest.approx(0.7)}, "b": {0: 0.5}}


# ---- accuracy ---------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def judged(spark):
    """One true and one false pair at 0.9, one true pair at 0.5, two true pairs never predicted."""
    records = table(spark, [("1", "p"), ("2", "p"), ("3", "q"), ("4", "q"), ("5", "r"), ("6", "r"), ("7", "s"), ("8", "s")], ["cluster"])
    rows = [("1", "2", 0.9), ("1", "3", 0.9), ("3", "4", 0.5)]
    pairs = spark.createDataFrame(rows, "unique_id_l string, unique_id_r string, match_probability double")
    return pairs.withColumn("source_dataset_l", F.lit("A")).withColumn("source_dataset_r", F.lit("A")), records


def test_truth_space(judged):
    rows = truth.truth_space(*judged).orderBy(F.desc_nulls_last("match_probability")).collect()
    assert [(r["match_probability"], r["tp"], r["fp"], r["fn"]) for r in rows] == [(0.9, 1, 1, 1), (0.5, 2, 1, 0), (None, 2, 1, 0)]
    assert (rows[0]["precision_val"], rows[0]["recall_val"], round(rows[0]["fstar"], 4)) == (0.5, 0.5, 0.3333)
    strict = truth.truth_space(*judged, strict=True).orderBy(F.desc("match_probability")).collect()
    assert [(r["match_probability"], r["fn"]) for r in strict] == [(0.9, 3), (0.5, 2)]
    assert (strict[1]["recall_val"], strict[1]["fstar"]) == (0.5, 0.4)


def test_confusion_matrix_agrees_with_strict_truth_space(judged):
    row = truth.confusion_matrix(*judged).first()
    assert (row["tp"], row["fp"], row["fn"], row["n_gt_edges"], row["recall"]) == (2, 1, 2, 4, 0.5)
    assert truth.missed_pairs(*judged).count() == row["fn"]


def test_confusion_matrix_edge_cases(judged):
    pairs, records = judged
    none = truth.confusion_matrix(pairs.limit(0), records).first()
    assert (none["tp"], none["precision"], none["fdr"], none["fnr"]) == (0, 0.0, 1.0, 1.0)
    assert truth.confusion_matrix(pairs, records.drop("cluster")).first()["unavailable"] is True


def test_crl(spark):
    space = spark.createDataFrame([(0.9, 0.05, 0.08, 0.8), (0.7, 0.09, 0.09, 0.9), (0.5, 0.3, 0.02, 0.7)],
                                  "match_probability double, fdr double, fnr double, fstar double")
    row = truth.crl_score(space, 0.1).first()
    assert (row["t_upper"], row["t_lower"]) == (0.9, 0.7) and abs(row["crl_score"] - 0.17) < 1e-9
    assert truth.crl_score(space, 0.01).first()["crl_score"] == 0.0
    curve = truth.crl_curve(space)
    assert curve.count() == 100
    assert abs(truth.epsilon_z(curve).first()["epsilon_z"] - 9 / 99) < 1e-12
    for row in curve.collect():
        assert abs(row["crl_score"] - truth.crl_score(space, row["epsilon"]).first()["crl_score"]) < 1e-9 if row["epsilon"] in (0.0, 1.0) else True


def test_metrics_of_an_empty_pair_table(judged):
    pairs, records = judged
    empty = pairs.limit(0).withColumn("match_weight", F.lit(1.0)).withColumn("match_key", F.lit(0))
    assert edge_metrics.n_edges(empty).first()[0] == 0
    assert edge_metrics.n_ids_with_edge(empty).first()[0] == 0
    assert edge_metrics.match_prob_stats(empty).first()[0] is None
    assert edge_metrics.linkage_rate(empty, records).first()["linkage_rate"] == 0.0
    assert {r["unlinkable_pct"] for r in edge_metrics.unlinkables(empty, records.agg(F.count("*"))).collect()} == {100.0}
    assert truth.crl_score(truth.truth_space(empty, records)).first()["crl_score"] == 0.0


def test_explorer_without_active_rules(judged):
    pairs, _ = judged
    assert explorer.filter_by_rules(pairs, {"name": False}).count() == 0
    assert explorer.filter_by_rules(pairs, {"not_there": True}).count() == 0


def test_cluster_comparison(spark):
    make = lambda rows: spark.createDataFrame(rows, "unique_id string, cluster_id string").withColumn("source_dataset", F.lit("A"))
    one = make([("1", "a"), ("2", "a"), ("3", "b"), ("4", "c")])
    two = make([("1", "a"), ("2", "a"), ("3", "z"), ("4", "y"), ("5", "y")])
    assert [r["run1_cluster_id"] for r in compare.exact_clusters(one, two).collect()] == ["a"]
    assert {r["run1_cluster_id"] for r in compare.exact_clusters(one, two, by_members=True).collect()} == {"a", "b"}
    assert [(r["run1_cluster_id"], r["run2_cluster_id"]) for r in compare.partial_clusters(one, two).collect()] == [("c", "y")]


# ---- models and whole runs -------------------------------------------------------------------------------------------

def test_model_type_rules_and_round_trip(spark, tmp_path):
    model = small_model()
    model["blocking_rules_to_generate_predictions"] = [{"blocking_rule": 'l."name" = r."name" AND l."city" = r."city"'}]
    assert models.detect_type(model) == "probabilistic"
    assert models.detect_type({"comparisons": build_comparisons(["a"])}) == "deterministic"
    assert models.detect_type({**model, "_app_linkage_type": "deterministic"}) == "deterministic"
    assert models.model_rules(model) == ([["name", "city"]], {})
    rebuilt = models.stored(models.with_params({**model, "comparisons": build_comparisons(["name", "city", "size"])}, scoring.model_params(spark, model).collect()))
    assert rebuilt["comparisons"][0]["comparison_levels"][1]["m_probability"] == 0.9
    assert rebuilt["comparisons"][0]["comparison_levels"][0]["m_probability"] is None
    assert rebuilt["probability_two_random_records_match"] == 0.05
    path = str(tmp_path / "model")
    models.write_model(spark, rebuilt, path)
    assert models.read_model(spark, path) == json.loads(json.dumps(rebuilt))
    assert models.levels_of(spark, path).count() == 9
    assert scoring.prior_log_odds(None) == -10.0


def test_model_validation():
    model = small_model()
    model["blocking_rules_to_generate_predictions"] = [{"blocking_rule": 'l."name" = r."name"'}, {"blocking_rule": 'l."x" = r."x"'}]
    kept = models.validate(model, {"name", "unique_id"})
    assert [c["output_column_name"] for c in kept["comparisons"]] == ["name"]
    assert len(kept["blocking_rules_to_generate_predictions"]) == 1
    with pytest.raises(ValueError):
        models.validate(model, {"size"})


def test_whole_deterministic_run(five):
    run = Linker(five, LinkConfig(["name", "city"], {"name": True, "city": True}))
    assert run.preflight().first()["n_pairs"] == 5
    assert run.predict().count() == 1
    sizes = sorted(r["count"] for r in run.cluster().groupBy("cluster_id").count().collect())
    assert sizes == [1, 1, 1, 2]
    facts = {r["metric"]: r["value"] for r in run.metrics().collect()}
    assert (facts["n_edges"], facts["n_clusters"], facts["linkage_rate"]) == (1.0, 4.0, 40.0)
    assert run.export().count() == 5
    sections = {r["section"] for r in run.summary().collect()}
    assert {"configuration", "results"} <= sections
    assert reports.export_stats(run.export()).first()["n_with_cluster"] == 5


def test_trained_run_finds_the_noisy_copies(spark):
    from queries import fixtures as x

    a, b = x.people_tables(spark, "/root/testdata/sf0.001")
    config = LinkConfig(x.PEOPLE_FIELDS, {"dob": True, "email": True}, "link", "probabilistic", composite_rules={"surname+birth_year": True},
                        comp_types=x.PEOPLE_TYPES)
    run = Linker(a, config, b)
    row = run.confusion_matrix().first()
    assert row["recall"] > 0.8 and row["precision"] > 0.8
    replay = Linker.from_model(a, run.model_document(), b, "link")
    assert replay.predict().count() == run.predict().count()


def test_link_mode_uses_common_columns_only(spark):
    a = table(spark, [("1", "ann", "x")], ["name", "city"])
    b = table(spark, [("2", "ann", "y")], ["name", "town"], "B")
    run = Linker(a, LinkConfig(["name", "city"], {"name": True, "city": True}, "link"), b)
    assert run.fields == ["name"] and run.rules == [["name"]]
    assert pair_set(run.predict()) == {("1", "2")}
    with pytest.raises(ValueError):
        Linker(a, LinkConfig(["city"], {"city": True}, "link"), b)


def test_long_rule_lists_are_counted_too(spark):
    rows = random_records(spark, 60, 23)
    df = table(spark, rows, ["name", "city", "size"])
    rules = RULES + [["size"], ["city", "name"], ["name", "size"], ["city"], ["size", "city"], ["name", "city", "size"], ["size"], ["city", "size", "name"]]
    counted = blocking.candidate_count(df, rules)
    assert counted.first()["n_pairs"] == len(brute(rows, rules))


def test_a_third_of_all_records_in_one_block(spark):
    """A hot block costs counts and stars no pairs: 200 million of them here."""
    n = 60_000
    rows = spark.range(n).selectExpr(
        "cast(id as string) AS unique_id", "'A' AS source_dataset", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('n', id div 2) END AS name",
        "CASE WHEN id % 3 = 0 THEN 'x' ELSE concat('c', id div 4) END AS city")
    hot = n // 3
    assert blocking.block_counts(rows, ["name", "city"]).first()["n_pairs"] >= hot * (hot - 1) // 2
    links = blocking.deterministic_links(rows, [["name"]], ["name", "city"])
    sizes = components.cluster_records(rows, links, hot_node=1000).groupBy("cluster_id").count().agg(F.max("count"), F.sum("count")).first()
    assert tuple(sizes) == (hot, n)


# ---- keys of unlike types, repeated ids, stored rules, made-up ids ---------------------------------------------------------------

@pytest.mark.parametrize("one,other", [("int", "bigint"), ("bigint", "double"), ("int", "string"), ("date", "string"), ("string", "string")])
def test_pairs_counts_and_links_agree_over_types(spark, one, other):
    make = lambda ids, source, kind: spark.createDataFrame([(str(i), source, v) for i, v in ids], "unique_id string, source_dataset string, v int").withColumn(
        "key", (F.date_add(F.lit("2020-01-01").cast("date"), F.col("v")) if "date" in (one, other) else F.col("v")).cast(kind)).drop("v")
    a, b = make([(1, 1), (2, 2), (3, None), (4, 1)], "A", one), make([(5, 1), (6, 2), (7, 9), (8, None)], "B", other)
    assert pair_set(blocking.candidate_pairs(a, [["key"]], [], b)) == {("1", "5"), ("4", "5"), ("2", "6")}
    assert blocking.candidate_count(a, [["key"]], b).first()["n_pairs"] == 3
    assert blocking.deterministic_pairs(a, [["key"]], ["key"], b).count() == 3
    links = blocking.deterministic_links(a, [["key"]], ["key"], b)
    sizes = components.cluster_records(blocking.both_tables(a, b), links).groupBy("cluster_id").count().collect()
    assert sorted(r["count"] for r in sizes) == [1, 1, 1, 2, 3]


def test_repeated_ids_are_no_pairs(spark):
    df = table(spark, [("1", "x", "k"), ("1", "x", "k"), ("2", "x", "m"), ("2", "y", "k"), ("3", "y", None)], ["name", "city"])
    for rules in ([["name"]], [["name"], ["city"]], [["name", "city"]]):
        pairs = blocking.candidate_pairs(df, rules, []).count()
        assert blocking.candidate_count(df, rules).first()["n_pairs"] == pairs
    truth_rows = df.withColumn("cluster", F.lit("c")).limit(3)
    assert blocking.truth_pair_count(truth_rows).first()["n_gt_edges"] == blocking.truth_pairs(truth_rows).count() == 2


def test_stored_rules_are_read_as_written():
    read = rules.read_rule
    assert read('l."a" = r."a"') == ([["`a`"]], None)
    assert read("(l.a = r.a) AND (r.b = l.b);") == ([["`a`", "`b`"]], None)
    assert read('SUBSTR(l."a",1,2) = SUBSTR( r."a", 1,2) and l.c <> r.c') == ([["SUBSTR(`a`,1,2)"]], "(`c_l` <> `c_r`)")
    assert read("l.a = r.a AND (l.b = r.b OR l.c = r.c)") == ([["`a`"]], "((`b_l` = `b_r`) OR (`c_l` = `c_r`))")
    assert read("l.a = r.a AND l.note <> 'x AND y'")[1] == "(`note_l` <> 'x AND y')"
    assert read("l.a = r.a AND l.note <> 'l.x AND r.x' AND r.note <> 'it''s \\'") == ([["`a`"]], "(`note_l` <> 'l.x AND r.x') AND (`note_r` <> 'it\\'s \\\\')")
    assert read("l.a = r.a AND abs(l.x - r.x) BETWEEN 0 AND 2 AND l.b = r.b") == ([["`a`", "`b`"]], "(abs(`x_l` - `x_r`) BETWEEN 0 AND 2)")
    assert read("l.a = r.a AND NOT l.x BETWEEN 0 AND 2 AND r.y IS NULL")[1] == "(NOT (`x_l` BETWEEN 0 AND 2)) AND (`y_r` IS NULL)"
    assert read("l.a = r.a AND CASE WHEN l.b = r.b AND l.c IS NULL THEN 1 ELSE 0 END = 1")[1] == "(CASE WHEN `b_l` = `b_r` AND `c_l` IS NULL THEN 1 ELSE 0 END = 1)"
    assert read("l.a = r.a OR l.b = r.b") == ([["`a`"], ["`b`"]], "(`a_l` = `a_r`) OR (`b_l` = `b_r`)")
    assert read("l.a = r.a AND l.b = r.b OR l.c = r.c AND l.d < r.d")[0] == [["`a`", "`b`"], ["`c`"]]
    assert read("(l.a = r.a OR l.b = r.b) AND l.c = r.c")[0] == [["`c`"]]
    assert read("(l.a, l.b) = (r.a, r.b)") == ([["(`a`, `b`)"]], None)
    assert rules.columns_of('l."a b" = r."a b" AND \'l.c\' <> r.d AND xl.e IS NULL') == ["a b", "d"]
    for bad in ("l.a < r.a", "l.a = r.b", "l.a = r.a OR l.b < r.b", "1 = 1", "NOT l.a = r.a", "l.a IS NULL = r.a IS NULL AND l.b <> r.b", "(l.a = r.a"):
        with pytest.raises(ValueError):
            read(bad)


def test_rules_with_or_find_what_a_full_test_finds(spark):
    import random

    rng = random.Random(8)
    rows = [(str(i), *[rng.choice(["x", "y", "z", "l.a", None]) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "unique_id string, a string, b string, c string, d string").withColumn("source_dataset", F.lit("A"))
    texts = ["(l.a = r.a AND l.b = r.b) OR (l.c = r.c AND l.d = r.d)", "l.a = r.a AND (l.b = 'l.a' OR r.c IS NULL)", "upper(l.d) = upper(r.d) OR l.b = r.b AND l.a <> r.a"]
    model = {**small_model(), "blocking_rules_to_generate_predictions": [{"blocking_rule": t} for t in texts]}
    model["comparisons"] = build_comparisons(["a", "b"])
    run = Linker.from_model(df, {**model, "_app_linkage_type": "deterministic"})
    got = {(r["unique_id_l"], r["unique_id_r"], r["match_key"]) for r in run.candidates().collect()}
    eq = lambda p, q: p is not None and q is not None and p == q
    three = [lambda l, r: (eq(l[1], r[1]) and eq(l[2], r[2])) or (eq(l[3], r[3]) and eq(l[4], r[4])),
             lambda l, r: eq(l[1], r[1]) and (eq(l[2], "l.a") or r[3] is None),
             lambda l, r: eq(l[4], r[4]) or (eq(l[2], r[2]) and None not in (l[1], r[1]) and l[1] != r[1])]
    wanted = set()
    for l in rows:
        for r in rows:
            if "A-" + l[0] < "A-" + r[0]:
                first = next((i for i, test in enumerate(three) if test(l, r)), None)
                if first is not None:
                    wanted.add((l[0], r[0], first))
    assert got == wanted and run.preflight().first()["n_pairs"] == len(wanted)


def test_unlike_key_types_meet_as_spark_compares_them(spark):
    import datetime
    import decimal

    def pairs(kind_a, kind_b, one, other):
        make = lambda kind, value, uid, source: spark.createDataFrame([(uid, source, value)], f"unique_id string, source_dataset string, k {kind}")
        a, b = make(kind_a, one, "1", "A"), make(kind_b, other, "2", "B")
        n = blocking.candidate_pairs(a, [["k"]], [], b).count()
        assert n == blocking.candidate_count(a, [["k"]], b).first()["n_pairs"]
        linked = blocking.deterministic_links(a, [["k"]], ["k"], b).count()
        assert linked == n
        return n

    day = datetime.date(2024, 5, 1)
    assert pairs("decimal(10,2)", "int", decimal.Decimal("1.00"), 1) == 1
    assert pairs("date", "timestamp", day, datetime.datetime(2024, 5, 1)) == 1 and pairs("date", "timestamp", day, datetime.datetime(2024, 5, 1, 1)) == 0
    assert pairs("double", "string", 1.0, "1") == 1 and pairs("string", "int", "x", 1) == 0 and pairs("string", "date", "2024-05-01", day) == 1
    assert pairs("decimal(10,2)", "double", decimal.Decimal("1.50"), 1.5) == 1 and pairs("tinyint", "decimal(20,0)", 7, decimal.Decimal(7)) == 1
    with pytest.raises(ValueError):
        pairs("int", "date", 1, day)


def test_second_table_is_suffixed_as_a_whole(spark):
    ids = lambda values: spark.createDataFrame([(v,) for v in values], "unique_id string")
    from kinsift.operators import cleaning

    suffixed = lambda values: sorted(r[0] for r in cleaning.suffix_ids(ids(values)).collect())
    assert suffixed(["5", "5_B"]) == ["5_B", "5_B_B"] and suffixed(["5_B", "6_B"]) == ["5_B", "6_B"] and suffixed([]) == []


def test_made_up_ids_hold_through_a_run_and_its_tables_go(spark):
    import os

    rows = spark.range(400).selectExpr("concat('n', id % 150) AS name", "concat('c', id % 7) AS city").repartition(5).distinct()
    run = Linker(rows, LinkConfig(["name", "city"], {"name": True}, linkage_type="deterministic"))
    export = {r["unique_id"]: r["name"] for r in run.export().collect()}
    assert len(export) == rows.count()
    for pair in run.predict().collect():
        assert export[pair["unique_id_l"]] == pair["name_l"] and export[pair["unique_id_r"]] == pair["name_r"]
    folders = {f.split(":", 1)[-1].rsplit("/", 1)[0] for df in run._written for f in df.inputFiles()}
    assert folders and all(os.path.isdir(f) for f in folders)
    run.close()
    assert not any(os.path.isdir(f) for f in folders)


def test_a_rare_equality_gets_its_counted_u(spark):
    df = spark.range(3000).selectExpr("cast(id as string) AS unique_id", "'A' AS source_dataset", "concat('e', id div 2) AS email")
    comparisons = build_comparisons(["email"])
    u = training.u_of_levels(df, comparisons, target=2000, sample=200)["email"]
    assert abs(u[1][0] - 1500 / (3000 * 2999 / 2)) < 1e-12 and u[1][1] and abs(sum(v for v, _ in u.values()) - 1) < 1e-9


def test_sharper_keys_stay_few(spark):
    model = {"probability_two_random_records_match": 1e-8, "comparisons": build_comparisons([f"f{i}" for i in range(12)])}
    for c in model["comparisons"]:
        for level in c["comparison_levels"]:
            if not level["is_null_level"]:
                top = "=" in level["sql_condition"]
                level["m_probability"], level["u_probability"] = (0.9, 0.05) if top else (0.1, 0.95)
    rules = [[f"f{i}"] for i in range(5)]
    assert len(scoring.reachable_rules(model, rules, -5.0)) <= scoring.KEYS_PER_RULE * len(rules)


def test_similarities_of_long_values_and_plain_damerau():
    import random

    import numpy as np
    import pandas as pd

    def plain(a, b):
        """Distance by table, one cell at a time."""
        far, seen = len(a) + len(b), {}
        grid = {(-1, -1): far, **{(i, -1): far for i in range(len(a) + 1)}, **{(-1, j): far for j in range(len(b) + 1)},
                **{(i, 0): i for i in range(len(a) + 1)}, **{(0, j): j for j in range(len(b) + 1)}}
        for i in range(1, len(a) + 1):
            col = 0
            for j in range(1, len(b) + 1):
                row, before = seen.get(b[j - 1], 0), col
                if a[i - 1] == b[j - 1]:
                    col = j
                grid[i, j] = min(grid[i - 1, j - 1] + (a[i - 1] != b[j - 1]), grid[i, j - 1] + 1, grid[i - 1, j] + 1,
                                 grid[row - 1, before - 1] + i - row + j - before - 1)
            seen[a[i - 1]] = i
        return grid[len(a), len(b)]

    rng = random.Random(3)
    left, right = (["".join(rng.choices("abcé", k=rng.randint(0, 11))) for _ in range(400)] for _ in range(2))
    got = similarity._damerau(pd.Series(left), pd.Series(right))
    assert [int(x) for x in got] == [plain(a, b) for a, b in zip(left, right)]
    some = [(a, b) for a, b in zip(left, right) if a and b]
    fast = similarity.jaro_array(*(np.array(x, dtype=object) for x in zip(*some)))
    assert np.allclose(fast, [similarity.jaro_of_long(a, b) for a, b in some])
    far = similarity._jaro_winkler(pd.Series(["x" * 10_000, "ab"]), pd.Series(["xy" * 5_000, "ab"]))
    assert abs(far[0] - 2 / 3) < 1e-9 and far[1] == 1.0


# ---- rules switched on and off, hubs, EM on arrays ------------------------------------------------------------------------------

def test_toggles_cluster_from_forests_and_read_the_pairs_once(spark, tmp_path):
    import shutil

    rows = random_records(spark, 70, 5)
    records = table(spark, rows, ["name", "city", "size"])
    scored = blocking.candidate_pairs(records, RULES, ["name", "city", "size"]).withColumn(
        "match_probability", F.when(F.pmod(F.hash("unique_id_l", "unique_id_r"), F.lit(4)) == 0, 0.3).otherwise(0.9)).withColumn("match_weight", F.lit(1.0))
    pairs = spark.createDataFrame(scored.collect(), scored.schema)
    pairs.write.parquet(str(tmp_path / "pairs"))
    keys = ["name", "city+size", "city", "absent"]
    views = explorer.RuleExplorer(records, spark.read.parquet(str(tmp_path / "pairs")), keys, 0.8, hot_node=5)
    shutil.rmtree(tmp_path / "pairs")
    groups = lambda df: {frozenset(m) for m in _members(df)}
    for switches in itertools.product([True, False], repeat=len(keys)):
        toggles = dict(zip(reversed(keys), switches))
        kept = explorer.filter_by_rules(pairs, toggles)
        assert groups(views.clusters(toggles)) == groups(components.cluster_pairs(records, kept, 0.8))
    assert groups(views.clusters()) == groups(components.cluster_pairs(records, pairs, 0.8))
    toggles = {"city": True, "name": False, "city+size": True}
    kept = explorer.filter_by_rules(pairs, toggles)
    label = lambda df: {(r["unique_id_l"], r["unique_id_r"], r["effective_rule"]) for r in df.where("effective_rule IS NOT NULL").collect()}
    assert label(views.pairs(toggles)) == label(kept)
    old = compare.recluster_delta(records, pairs, kept, components.cluster_pairs(records, pairs, 0.8), 0.8)
    assert sorted(map(tuple, views.delta(toggles).collect())) == sorted(map(tuple, old.collect()))
    assert {r["unique_id"] for r in views.touched(toggles).collect()} == {r["unique_id"] for r in explorer.touched_records(records, kept).collect()}
    views.close()


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[j - 1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def _members(clusters):
    out = {}
    for r in clusters.collect():
        out.setdefault(r["cluster_id"], []).append(r["unique_id"])
    return out.values()


def test_hubs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(components, "HUBS", 2)
    rng = random.Random(3)
    edges = [(f"n{i % 4}", f"m{i}") for i in range(300)] + [(f"m{rng.randrange(300)}", f"x{i}") for i in range(200)]
    df = spark.createDataFrame(edges, "node_l string, node_r string")
    parent = {}

    def root(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r["node"]: r["label"] for r in components.component_labels(df, hot_node=10).collect()} == {n: root(n) for n in list(parent)}


def test_em_on_arrays_is_em_in_spark(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.randint(1, 400), a, b, c) for a in (-1, 0, 1, 2) for b in (-1, 0, 1) for c in (0, 2)]
    patterns = spark.createDataFrame(rows, "n long, gamma_a int, gamma_b int, gamma_c int")
    m = {"a": {0: 0.05, 1: 0.05, 2: 0.9}, "b": {0: 0.1, 1: 0.9}, "c": {0: 0.05, 1: 0.05, 2: 0.9}}
    u = {"a": {0: 0.9, 1: 0.07, 2: 0.03}, "b": {0: 0.8, 1: 0.2}, "c": {0: 0.7, 1: 0.2, 2: 0.1}}
    one = training.em_train(patterns, m, u, 0.01, 8, 0.0)
    monkeypatch.setattr(training, "LOCAL_PATTERNS", 0)
    two = training.em_train(patterns, m, u, 0.01, 8, 0.0)
    assert one[2] == two[2] == {("c", 1)} and abs(one[1] - two[1]) < 1e-12
    assert all(abs(one[0][f][g] - two[0][f][g]) < 1e-12 for f in m for g in m[f])


@pytest.mark.parametrize("function,threshold", [("levenshtein", 1), ("levenshtein", 2), ("jaro_similarity", 0.85), ("jaro_winkler_similarity", 0.88), ("jaro_winkler_similarity", 0.92)])
def test_alike_values_are_all_found(spark, function, threshold):
    rng = random.Random(threshold)
    words = {"", "a", "aa", "ab", "ba"} | {"".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(160)}
    near = {w[:i] + c + w[i + 1:] for w in list(words)[:60] for i, c in [(rng.randrange(max(len(w), 1)), rng.choice("abcdé"))]}
    words = sorted(words | near)
    values = spark.createDataFrame([(w, 1, 1) for w in words], "value string, n long, na long")
    similarity.register(spark)
    test = f"levenshtein(value_l, value_r) <= {threshold}" if function == "levenshtein" else f"{function}(value_l, value_r) >= {threshold}"
    every = values.select(F.col("value").alias("value_l")).crossJoin(values.select(F.col("value").alias("value_r"))).where("value_l < value_r").where(test)
    found = value_join.alike(values, function, threshold)
    wanted = {tuple(r) for r in every.collect()}
    got = [(r["value_l"], r["value_r"]) for r in found.collect()]
    assert len(got) == len(set(got)) and wanted <= set(got) and len(wanted) > 20


@pytest.fixture(scope="module")
def alike_rows():
    """Records of few profiles; some ids and values are null, some ids come twice."""
    rng = random.Random(3)
    out = [(f"{i % 170}" if i % 41 else None, rng.choice(["ann", "anne", "bob", None]), rng.choice(["x", "xy", "z", None]), rng.choice("AB")) for i in range(180)]
    return out + out[:6]


def folded_model():
    comparisons = build_comparisons(["name", "city"], {"name": "JaroWinklerAtThresholds"})
    for c in comparisons:
        real = [level for level in c["comparison_levels"] if not level["is_null_level"]]
        for k, level in enumerate(real):
            level["m_probability"], level["u_probability"] = 0.6 / (k + 1), 0.2 * (k + 1)
    return {"comparisons": comparisons, "probability_two_random_records_match": 0.2}


@pytest.mark.parametrize("link", [False, True])
@pytest.mark.parametrize("hot_block", [2, 2000])
def test_folded_records_give_the_pairs_of_their_records(spark, alike_rows, monkeypatch, link, hot_block):
    records = spark.createDataFrame(alike_rows, "unique_id string, name string, city string, source_dataset string")
    a, b = (records.where("source_dataset = 'A'"), records.where("source_dataset = 'B'")) if link else (records, None)
    rules, found = [["name"], ["city"]], {}
    for members in (None, 3, 500):
        monkeypatch.setattr(blocking, "folds_well", lambda *_: members is not None)
        monkeypatch.setattr(blocking.fold, "__defaults__", (False, members or 500))
        pairs = scoring.predict_folded(a, rules, folded_model(), b, threshold=-2.0, hot_block=hot_block)
        assert ("_members_l" in pairs.columns) == (members is not None)
        plain = blocking.unfold(pairs)
        ends = components.component_labels(components.edges_of(pairs, 0.3))
        found[members] = (plain.columns, sorted(map(str, plain.collect())), sorted(map(str, ends.collect())))
    assert found[None] == found[3] == found[500] and len(found[None][1]) > 500


def test_alike_records_are_scored_once(spark):
    """A thousand records of two profiles: half a million pairs from no more than four scored ones."""
    records = spark.range(1000).selectExpr("cast(id AS string) AS unique_id", "if(id % 2 = 0, 'ann', 'anne') AS name", "'x' AS city", "'A' AS source_dataset")
    pairs = scoring.predict_folded(records, [["city"]], folded_model(), threshold=None)
    assert pairs.count() <= 4 and blocking.unfold(pairs).count() == 1000 * 999 // 2


def test_rules_are_read_once_for_alike_records(spark):
    records = spark.range(400).selectExpr("cast(id AS string) AS unique_id", "concat('n', id % 3) AS name", "'x' AS city", "'A' AS source_dataset")
    pairs = blocking.candidate_pairs(records, [["city"]], ["name"], folded=True)
    assert pairs.count() <= 9 and blocking.unfold(pairs).count() == 400 * 399 // 2


def test_pairs_of_a_small_table_are_made_in_many_tasks(spark):
    """Adaptive execution would merge the partitions of a small table, however many pairs it makes."""
    records = spark.range(2000).selectExpr("cast(id AS string) AS unique_id", "concat('n', id % 200) AS name", "'A' AS source_dataset")
    used = blocking.candidate_pairs(records, [["name"]], []).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= 4


@pytest.mark.parametrize("function,threshold", [("levenshtein", 2), ("jaro_winkler_similarity", 0.9)])
def test_tokens_of_values_never_pass_the_driver(spark, function, threshold):
    """A few values become very many tokens, which the planner does not see."""
    values = spark.range(300).selectExpr("concat('Customer#', lpad(id, 9, '0')) AS value", "1L AS n", "1L AS na")
    plan = value_join.alike(values, function, threshold)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [token" in plan and "value_l" not in "".join(line for line in plan.splitlines() if "BroadcastExchange" in line)


def test_values_that_cannot_reach_the_threshold_are_no_candidates(spark):
    values = spark.range(400).selectExpr("cast(100000 + id * 7919 % 900000 as string) AS value", "1L AS n", "1L AS na")
    rows = [r["value"] for r in values.collect()]
    edits = sum(plain_levenshtein(a, b) <= 2 for a, b in itertools.combinations(rows, 2))
    assert value_join.alike(values, "levenshtein", 2).count() == edits
    assert value_join.alike(values, "jaro_winkler_similarity", 0.9).count() < 400 * 399 / 2 / 20


def test_u_of_rare_levels_is_counted_and_the_rest_shared(spark):
    rng = random.Random(5)
    rows = [(str(i), "".join(rng.choices("abcd", k=4)), "A") for i in range(120)]
    df = spark.createDataFrame(rows, "unique_id string, name string, source_dataset string")
    comparisons = build_comparisons(["name"], {"name": "LevenshteinAtThresholds"})
    u = training.u_of_levels(df, comparisons, target=500, sample=100)["name"]
    n = {}
    pairs = [(a[1], b[1]) for a, b in itertools.combinations(rows, 2)]
    for a, b in pairs:
        d = plain_levenshtein(a, b)
        g = 3 if d == 0 else 2 if d == 1 else 1 if d == 2 else 0
        n[g] = n.get(g, 0) + 1
    assert all(abs(u[g][0] - n.get(g, 0) / len(pairs)) < 1e-12 for g in (1, 2, 3)) and abs(sum(v for v, _ in u.values()) - 1) < 1e-9


@pytest.mark.parametrize("link", [False, True])
def test_missed_blocks_expand_to_the_missed_pairs(spark, link):
    rng = random.Random(11)
    rows = [(f"{i}", rng.choice(["x", "y", None]), rng.choice(["p", "q", "r", None]), f"c{rng.randrange(6)}" if rng.random() < 0.9 else None, rng.choice("AB")) for i in range(80)]
    records = spark.createDataFrame(rows, "unique_id string, name string, city string, cluster string, source_dataset string")
    if not link:
        records = records.withColumn("source_dataset", F.lit("A"))
    rules, fields = [["name", "city"]], ["name", "city"]
    pairs = (blocking.deterministic_pairs(records.where("source_dataset = 'A'"), rules, fields, records.where("source_dataset = 'B'"), keep=["cluster"]) if link
             else blocking.deterministic_pairs(records, rules, fields, keep=["cluster"]))
    blocks = truth.missed_blocks(pairs, records, fields, link, hot_block=3)
    plain = {frozenset([r["unique_id_l"], r["unique_id_r"]]) for r in truth.missed_pairs(pairs, records, link).collect()}
    got = [frozenset([r["unique_id_l"], r["unique_id_r"]]) for r in truth.expand_missed(blocks, records, fields, link).collect()]
    assert len(got) == len(set(got)) and set(got) == plain and plain
    assert blocks.agg(F.sum("n_missed")).first()[0] == len(plain)
    without = pairs.drop("cluster_l", "cluster_r")
    assert sorted(map(tuple, truth.missed_blocks(without, records, fields, link).collect())) == sorted(map(tuple, blocks.collect()))


def test_a_large_cluster_costs_its_blocks(spark):
    rows = spark.range(100_000).selectExpr("cast(id as string) AS unique_id", "'A' AS source_dataset", "concat('n', id % 3) AS name", "'one' AS cluster")
    pairs = spark.createDataFrame([], "unique_id_l string, unique_id_r string, name_l string, name_r string, cluster_l string, cluster_r string")
    found = truth.missed_blocks(pairs, rows, ["name"]).collect()
    assert len(found) == 6 and sum(r["n_missed"] for r in found) == 100_000 * 99_999 // 2


def test_pairs_without_hope_meet_no_string_similarity(spark, monkeypatch):
    """A cheap comparison rules the pair out, so its text never reaches the similarity; the pairs kept are those of plain scoring."""
    from pyspark.sql import types as T
    from kinsift.functions import similarity

    def poisoned(left, right):
        assert "poison" not in set(left) | set(right)
        return pd.Series([1.0 if a == b else 0.95 for a, b in zip(left, right)])
    poisoned.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.Series}
    monkeypatch.setattr(similarity, "jaro_winkler_similarity", F.pandas_udf(poisoned, T.DoubleType()).asNondeterministic())
    comparisons = build_comparisons(["name", "code"], {"name": "JaroWinklerAtThresholds", "code": "LevenshteinAtThresholds"})
    for c in comparisons:
        real = [level for level in c["comparison_levels"] if not level["is_null_level"]]
        for level, (m, u) in zip(real, [(0.6, 0.01), (0.3, 0.1), (0.09, 0.3), (0.0001, 0.59)]):
            level["m_probability"], level["u_probability"] = m, u
    model = {"comparisons": comparisons, "probability_two_random_records_match": 0.01}
    rows_ = [("1", "A", "x", "anna", "1234"), ("2", "A", "x", "hanna", "1235"), ("3", "A", "x", "poison", "987654")]
    records = spark.createDataFrame(rows_, "unique_id string, source_dataset string, city string, name string, code string")
    found = scoring.predict(records, [["city"]], model, threshold=-5.0).select("unique_id_l", "unique_id_r", "gamma_name", "gamma_code").collect()
    assert [tuple(r) for r in found] == [("1", "2", 2, 2)]


def test_parts_of_a_side_are_made_once_a_record():
    """Calls on one side's column become columns of the records; what reads both sides stays."""
    from kinsift.operators.comparators import by_side
    made, comparisons = by_side(build_comparisons(["dob", "email"], {"dob": "DateOfBirthComparison", "email": "EmailComparison"}))
    assert sorted(made.values()) == ["substring_index(`email`, '@', 1)", "try_to_date(`dob`, 'yyyy-MM-dd')"]
    text = " ".join(level["sql_condition"] for c in comparisons for level in c["comparison_levels"])
    assert "try_to_date" not in text and "substring_index" not in text and "levenshtein(`dob_l`, `dob_r`)" in text


def test_rules_that_the_records_make_superfluous_are_not_counted(spark):
    """Equal names have equal initials and lengths here, so their pairs are among those of the initials; a null determines nothing."""
    rng = random.Random(5)
    words = ["ann", "anne", "bob", "carl", "eve"]
    data = [(str(i), "A", w, w[0], len(w) if i % 9 else None, i % 4, i % 8, f"{i % 3}{i % 5}", str(i % 5)) for i in range(90) for w in [rng.choice(words)]]
    fields = ["name", "initial", "size", "four", "eight", "mix", "five"]
    records = spark.createDataFrame(data, "unique_id string, source_dataset string, name string, initial string, size int, four int, eight int, mix string, five string")
    rules_ = [[f] for f in fields]
    assert blocking.determined(records, ["name", "initial", "size"]) == {"name": {"initial"}, "initial": set(), "size": set()}
    assert blocking.needed_rules(records, rules_) == [["initial"], ["size"], ["four"], ["five"]]
    assert blocking.candidate_count(records, rules_).first()[0] == blocking.candidate_pairs(records, rules_, []).count()


@pytest.mark.parametrize("link", [False, True])
def test_folded_pairs_are_counted_as_their_records_would_be(spark, alike_rows, monkeypatch, link):
    """Counts, ids and best weights from folded rows, none of them unfolded, with null and repeated ids."""
    records = spark.createDataFrame(alike_rows, "unique_id string, name string, city string, source_dataset string")
    a, b = (records.where("source_dataset = 'A'"), records.where("source_dataset = 'B'")) if link else (records, None)
    monkeypatch.setattr(blocking, "folds_well", lambda *_: True)
    monkeypatch.setattr(blocking.fold, "__defaults__", (False, 7))
    folded = blocking.weighed(scoring.predict_folded(a, [["name"], ["city"]], folded_model(), b, threshold=-2.0))
    plain = blocking.unfold(folded)
    assert "_members_l" in folded.columns and "_n" not in plain.columns
    of = lambda df: sorted(map(str, df.collect()))
    for metric in (edge_metrics.n_edges, edge_metrics.n_ids_with_edge, edge_metrics.match_prob_hist, edge_metrics.match_weight_hist, edge_metrics.match_prob_stats,
                   edge_metrics.weight_percentiles, edge_metrics.gamma_means, edge_metrics.blocking_counts, lambda p: compare.prob_comparison(p, p),
                   lambda p: edge_metrics.unlinkables(p, records.agg(F.count("*"))), lambda p: edge_metrics.unlinkables(p, records.agg(F.count("*")), True),
                   lambda p: explorer.touched_records(records, p.where("match_probability >= 0.3"))):
        assert of(metric(folded)) == of(metric(plain))


def test_status_of_edges_from_folded_rows(spark, monkeypatch):
    rng = random.Random(8)
    rows_ = [(str(i), rng.choice(["ann", "anne", "bob", None]), rng.choice(["x", "y", None]), "A") for i in range(60)]
    make = lambda data: spark.createDataFrame(data, "unique_id string, name string, city string, source_dataset string")
    records = make(rows_)
    monkeypatch.setattr(blocking, "folds_well", lambda *_: True)
    runs = [scoring.predict_folded(records, rules_, folded_model(), threshold=-2.0) for rules_ in ([["name"], ["city"]], [["name"], ["city", "name"]])]
    status = compare.folded_status(*runs, records)
    plain = [blocking.unfold(run) for run in runs]
    of = lambda df: sorted(map(str, df.collect()))
    assert of(blocking.unfold(status).select(*compare.KEYS, "category")) == of(compare.edge_status(*plain))
    assert of(compare.count_status(status)) == of(compare.edge_diff(*plain)) and status.count() < 200
    assert compare.folded_status(*runs, make(rows_ + rows_[:1])) is None


@pytest.mark.parametrize("link", [False, True])
def test_small_tiles_copy_no_record_for_each_chunk(spark, link):
    """A block of 600 records in 300 chunks: chunks are shuffled once, not copied for each chunk they meet; repeated and null ids, all pairs, and several strips."""
    rows = [(None if i % 97 == 0 else str(i % 590), "ann", str(i % 7) if i % 5 else None) for i in range(600)]
    a = table(spark, rows, ["name", "size"])
    b = table(spark, rows[:300], ["name", "size"], "B") if link else None
    rules, of = [["name"], ["size"]], lambda df: sorted(map(str, df.select("unique_id_l", "unique_id_r", "size_l", "size_r", "match_key").collect()))
    wanted = of(blocking.candidate_pairs(a, rules, ["size"], b, hot_block=None))
    old = blocking.HOT_BLOCK
    try:
        for strip in (old, 100):
            blocking.HOT_BLOCK = strip
            assert of(blocking.candidate_pairs(a, rules, ["size"], b, hot_block=2)) == wanted
    finally:
        blocking.HOT_BLOCK = old
    dealt = blocking._chunked(blocking._keyed(a, rules, ["size"]), blocking._hot(blocking._keyed(a, rules, ["size"]), 2, "_n"), "_n", "_n", 2)
    assert dealt.agg(F.sum(F.size("_rows"))).first()[0] == sum(1 for r in rows for v in r[1:] if v)


def test_values_of_left_records_are_joined_before_pairs_are_unfolded(spark):
    """As a join with the unfolded pairs, with repeated ids and records without a value; the joined rows are the folded ones."""
    records = table(spark, [(str(i % 110), "ann" if i % 2 else "bob", str(i % 3)) for i in range(120)], ["name", "size"])
    folded = blocking.candidate_pairs(records, [["name"]], ["size"], folded=True)
    values = records.where("unique_id <> '7'").selectExpr("unique_id", "source_dataset", "'v' || unique_id || size AS label")
    joined = blocking.with_left(folded, values)
    of = lambda df: sorted(map(tuple, df.select("unique_id_l", "unique_id_r", "size_l", "size_r", "label").collect()))
    plain = blocking.unfold(folded)
    wanted = of(plain.join(values.withColumnsRenamed({"unique_id": "unique_id_l", "source_dataset": "source_dataset_l"}), ["unique_id_l", "source_dataset_l"]))
    assert "_members_l" in joined.columns and joined.count() <= 36 and of(blocking.unfold(joined)) == wanted
    assert of(blocking.unfold(blocking.with_left(plain, values))) == wanted


def wide_table(spark, rows, fields):
    schema = ", ".join(["unique_id string", "source_dataset string", *[f"{f} int" for f in fields]])
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("link", [False, True])
def test_many_sets_of_fields_are_counted_without_a_row_per_set(spark, link, monkeypatch):
    """seven fields have 127 sets; profiles are not copied once a set, and nulls, repeated ids and repeated rows count as they do for few sets."""
    rng, fields = random.Random(5), [f"f{i}" for i in range(7)]
    rows = []
    for i in range(90):
        values = [None if rng.random() < 0.1 else rng.randrange(2 + 3 * k) for k in range(7)]
        rows += [(str(i if link else i % 70), rng.choice("AB") if link else "A", *values)] * rng.choice([1, 1, 2])
    expected = {}
    for a, b in itertools.combinations(rows, 2):
        if (a[1] == b[1]) if link else (a[0] == b[0]):
            continue
        covers = tuple(x is not None and x == y for x, y in zip(a[2:], b[2:]))
        if any(covers):
            expected[covers] = expected.get(covers, 0) + 1
    monkeypatch.setattr(blocking, "_masked", lambda *_: pytest.fail("a profile became one row per set of fields"))
    found = {tuple(r[f"covers_{f}"] for f in fields): r["n_pairs"] for r in blocking.agreement_patterns(wide_table(spark, rows, fields), fields, link).collect()}
    assert found == expected


def folded_pair_table(spark, rng, ordered, n=60):
    """Pairs of folded rows with members that lie among each other, and the record pairs that they stand for."""
    rows_ = [(str(i), rng.choice("AB") if not ordered else "A", rng.choice("xyz"), rng.choice(["1", "2", None])) for i in range(n)]
    records = spark.createDataFrame(rows_, "unique_id string, source_dataset string, name string, city string")
    a, b = (records, None) if ordered else (records.where("source_dataset = 'A'"), records.where("source_dataset = 'B'"))
    return records, blocking.candidate_pairs(a, [["name"], ["city"]], ["name", "city"], b, folded=True)


@pytest.mark.parametrize("ordered", [True, False])
def test_folded_pairs_are_weighed_and_tied_as_their_record_pairs(spark, ordered):
    """F8, F10, F15: pairs in order are counted without sorting per pair, and a row's records are tied once, not once for each of its pairs."""
    records, pairs = folded_pair_table(spark, random.Random(11), ordered)
    assert "_members_l" in pairs.columns
    plain = blocking.unfold(pairs)
    count = lambda df, n: {tuple(r) for r in df.groupBy("name_l", "name_r", "city_l", "city_r").agg(n.alias("n")).collect()}
    assert count(blocking.weighed(pairs), F.sum("_n")) == count(plain, F.count("*"))
    ends = lambda df: {tuple(r) for r in blocking.ends(df).distinct().collect()}
    assert ends(pairs) == ends(plain)
    ties = blocking.ties(pairs)
    labels = lambda edges: {tuple(r) for r in components.component_labels(edges).collect()}
    assert labels(ties) == labels(blocking.ties(plain))
    assert ties.count() <= pairs.count() + 2 * records.count()
    each = pairs.withColumn("rule", F.when(F.col("name_l") == F.col("name_r"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))
    for rule, kept in ((0, plain.where("name_l = name_r")), (1, plain)):
        assert labels(blocking.ties(each, "rule").where(F.col("rule") == rule)) == labels(blocking.ties(kept))


def test_two_folded_runs_are_compared_without_unfolding(spark, monkeypatch):
    """edges of two runs are counted and marked from folded rows that meet by their first records."""
    records, one = folded_pair_table(spark, random.Random(3), True)
    two = blocking.candidate_pairs(records, [["city"]], ["name", "city"], folded=True)
    runs = [df.withColumn("match_probability", F.lit(0.5)) for df in (one, two)]
    plain = [blocking.unfold(df) for df in runs]
    tuples = lambda df: sorted(tuple(r) for r in df.collect())
    counts, status = tuples(compare.edge_diff(*plain)), tuples(compare.edge_status(*plain))
    clusters = [components.cluster_pairs(records, df, 0.4) for df in plain]
    headline = tuples(compare.inter_metrics(*plain, *clusters))
    marked = compare.folded_status(*runs, records)
    assert tuples(blocking.unfold(marked).select("unique_id_l", "unique_id_r", "category")) == status
    monkeypatch.setattr(compare, "unfold", lambda _: pytest.fail("pairs were unfolded"))
    assert tuples(compare.edge_diff(*runs, records)) == counts
    assert tuples(compare.inter_metrics(*[blocking.weighed(df) for df in runs], *clusters, records)) == headline


def test_texts_in_order_are_counted_by_bytes_with_nulls_and_empty_lists(spark):
    from kinsift.functions.orders import ordered_pairs

    rows = [(["b", "a", "é"], ["a", "c", "z", "b"]), ([], ["a"]), (None, ["a"]), (["a", None], ["b", None]), (["10", "9"], ["9", "91"])]
    df = spark.createDataFrame(rows, "l array<string>, r array<string>")
    assert [r[0] for r in df.select(ordered_pairs("l", "r").alias("n")).collect()] == [5, 0, 0, 1, 3]


@pytest.mark.parametrize("link", [False, True])
def test_patterns_of_fields_with_few_values_are_looked_up(spark, link, monkeypatch):
    """gammas of a field with few values are worked out once a pair of values, and count the same; a field with many is compared pair by pair."""
    from kinsift.operators import comparators

    rng = random.Random(2)
    names, sizes = ["ann", "anne", "bob", "bobby", None, ""], ["1", "12", "123", "9", None]
    make = lambda source, k: table(spark, [(f"{source}{i}", rng.choice(names), rng.choice(sizes), rng.choice("xy")) for i in range(k)], ["name", "size", "kind"], source)
    a, b = make("A", 60), make("B", 30) if link else None
    model = build_comparisons(["name", "size"], {"name": "JaroWinklerAtThresholds", "size": "LevenshteinAtThresholds"})
    rows = lambda: sorted(tuple(r) for r in training.pattern_counts(a, ["kind"], model, b).select("gamma_name", "gamma_size", "n").collect())
    looked_up = rows()
    assert set(comparators.of_few_values([a], model)) == {"name", "size"}
    monkeypatch.setattr(comparators, "FEW_VALUES", 0)
    assert comparators.of_few_values([a], model) == {}
    assert rows() == looked_up and any(-1 in r for r in looked_up)


@pytest.mark.parametrize("function, threshold", [("jaro_similarity", 0.8), ("jaro_winkler_similarity", 0.9)])
def test_bits_of_characters_never_lose_a_pair_that_reaches_the_threshold(spark, function, threshold):
    """the cheap bound over bits comes first, and is never below what the characters themselves allow."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("0123456789abcdefghij") for _ in range(rng.randint(1, 40))) for _ in range(80)} | {str(rng.randrange(10_000, 99_999)) for _ in range(80)})
    values = spark.createDataFrame([(w, 1, 1) for w in words], "value string, n long, na long")
    score = similarity.jaro_array if function == "jaro_similarity" else similarity.jaro_winkler_array
    pairs = list(itertools.combinations(words, 2))
    scores = score([a for a, _ in pairs], [b for _, b in pairs])
    found = {(r["value_l"], r["value_r"]) for r in value_join.alike(values, function, threshold).collect()}
    assert {p for p, s in zip(pairs, scores) if s >= threshold} <= found
    assert "bit_count" in value_join.alike(values, function, threshold)._jdf.queryExecution().toString()


def test_folded_pairs_asked_for_once_are_not_written(spark):
    """a replayed model whose pairs are read once writes its records only; asked again, it writes the pairs and gives the same."""
    rng = random.Random(4)
    records = table(spark, [(str(i), rng.choice("xyz"), rng.choice("12")) for i in range(60)], ["name", "city"])
    model = {**folded_model(), "blocking_rules_to_generate_predictions": [{"blocking_rule": blocking.rule_sql(["name"])}]}
    run = Linker.from_model(records, model)
    rows = lambda df: sorted(tuple(r) for r in blocking.unfold(df).select("unique_id_l", "unique_id_r", "match_weight").collect())
    once = rows(run.folded())
    assert len(once) > 60 and len(run._written) == 1
    assert rows(run.folded()) == once and len(run._written) == 2
    assert rows(run.folded()) == once and len(run._written) == 2
    run.close()
