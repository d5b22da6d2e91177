"""Run-to-run comparison."""
from pyspark.sql import functions as F

from kinsift.functions.numbers import ratio, rounded
from kinsift.functions.quantiles import probability_strip, weighted_quantiles
from kinsift.operators import cluster_metrics, edge_metrics
from kinsift.operators.blocking import fold, unfold, weighed
from kinsift.operators.components import cluster_pairs
from kinsift.session import many_tasks, materialise

KEYS = ["unique_id_l", "unique_id_r"]
FULL_KEYS = KEYS + ["source_dataset_l", "source_dataset_r"]


def _rows(row, cells, schema):
    names = [part.split()[0] for part in schema.split(", ")]
    return row.select(F.explode(F.array(*[
        F.struct(*[c.alias(n) for c, n in zip(cell, names)]) for cell in cells])).alias("x")).select("x.*")


def edge_status(pairs1, pairs2, keys=KEYS):
    """Every edge of either run, marked shared, added or removed."""
    one = pairs1.select(*keys, F.lit(True).alias("in_1"))
    two = pairs2.select(*keys, F.lit(True).alias("in_2"))
    return one.join(two, keys, "full").select(*keys, _category())


def _alike_runs(pairs1, pairs2, records):
    """Whether folded rows of both runs can be told by their first record: both must fold by the same columns, and no id may occur twice."""
    columns = {"_members_l"} <= set(pairs1.columns) and set(pairs1.columns) - {"_n"} == set(pairs2.columns) - {"_n"}
    return columns and records.agg(F.count("unique_id") == F.count_distinct("unique_id")).first()[0] is True


def _category():
    return F.when(F.col("in_1") & F.col("in_2"), "shared").when(F.col("in_2"), "added").otherwise("removed").alias("category")


def folded_status(pairs1, pairs2, records):
    """`edge_status` of two runs over the same records before their pairs are unfolded, or none where that cannot be told from folded rows. The rows meet by their
    first records alone, and their records are joined after that."""
    if not _alike_runs(pairs1, pairs2, records):
        return None
    # A run has all pairs of two rows or none.
    side = lambda pairs, i: pairs.select("_first_l", "_first_r", F.lit(True).alias(f"in_{i}"))
    status = side(pairs1, 1).join(side(pairs2, 2), ["_first_l", "_first_r"], "full").select("_first_l", "_first_r", _category())
    fields = [c[:-2] for c in pairs1.columns if c.endswith("_l") and c[:-2] in records.columns and c[:-2] not in ("unique_id", "source_dataset")]
    rows = materialise(fold(records, fields).select("_first", "_last", "source_dataset", "_members"))
    named = lambda s: rows.withColumnsRenamed({c: f"{c}_{s}" for c in rows.columns})
    # Few rows that many pairs are made of: their number of tasks is fixed.
    deal = lambda df, c: df.repartition(many_tasks(records.sparkSession), c)
    beside = deal(status, "_first_r").join(named("r"), "_first_r")
    return deal(beside, "_first_l").join(named("l"), "_first_l").select(
        *[f"{c}_{s}" for c in ("source_dataset", "_members", "_first", "_last") for s in "lr"], F.lit(True).alias("_ordered"), "category")


def edge_diff(pairs1, pairs2, records=None):
    """Number of shared, added and removed edges, zeros included. Pairs of folded rows over the same `records` are counted as they are where they can be."""
    if records is None or not _alike_runs(pairs1, pairs2, records):
        return count_status(edge_status(unfold(pairs1), unfold(pairs2)))
    side = lambda pairs, i: (pairs if "_n" in pairs.columns else weighed(pairs)).select("_first_l", "_first_r", F.col("_n").alias(f"_n_{i}"), F.lit(True).alias(f"in_{i}"))
    both = side(pairs1, 1).join(side(pairs2, 2), ["_first_l", "_first_r"], "full")
    return count_status(both.select(_category(), F.coalesce("_n_1", "_n_2").alias("_n")))


def count_status(status):
    """Number of shared, added and removed edges of a status table, folded or not, zeros included."""
    counts = status if "_n" in status.columns else weighed(status)
    row = counts.agg(*[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("_n"))), F.lit(0)).alias(c) for c in ("shared", "added", "removed")])
    return _rows(row, [(F.lit(c), F.col(c)) for c in ("shared", "added", "removed")], "category string, n long")


def labelled_runs(df1, df2):
    """Both runs in one table; columns found in only one of them are null in the other."""
    return (df1.withColumn("run", F.lit("Run 1"))
            .unionByName(df2.withColumn("run", F.lit("Run 2")), allowMissingColumns=True))


def prob_comparison(pairs1, pairs2):
    scores = lambda pairs: (pairs if "_n" in pairs.columns else weighed(pairs)).select("match_probability", "_n")
    counted = labelled_runs(scores(pairs1), scores(pairs2)).groupBy("run", "match_probability").agg(F.sum("_n").alias("n"))
    middle = weighted_quantiles(counted, "match_probability", {"median": 0.5}, probability_strip, ["run"])
    known = F.when(F.col("match_probability").isNotNull(), F.col("n"))
    sums = counted.groupBy("run").agg(edge_metrics.exact_sum(F.col("match_probability"), F.col("n")).cast("double").alias("s"),
                                      F.sum(known).alias("known"), F.sum("n").alias("n_edges"))
    return sums.join(F.broadcast(middle), "run", "left").select(
        "run", rounded(ratio(F.col("s"), F.col("known")), 4).alias("mean_match_prob"), rounded(F.col("median"), 4).alias("median_match_prob"), "n_edges")


def cluster_overlap(clusters1, clusters2):
    """Pairs of clusters with a common record: sizes and how many records they share.

    Comparing the shared count with both sizes tells equal, partial and disjoint member sets apart
    without ever gathering a member list.
    """
    size1 = clusters1.groupBy("cluster_id").agg(F.count("*").alias("n_run1")).withColumnRenamed("cluster_id", "run1_cluster_id")
    size2 = clusters2.groupBy("cluster_id").agg(F.count("*").alias("n_run2")).withColumnRenamed("cluster_id", "run2_cluster_id")
    members = (clusters1.select("unique_id", "source_dataset", F.col("cluster_id").alias("run1_cluster_id"))
               .join(clusters2.select("unique_id", "source_dataset", F.col("cluster_id").alias("run2_cluster_id")),
                     ["unique_id", "source_dataset"]))
    shared = members.groupBy("run1_cluster_id", "run2_cluster_id").agg(F.count("*").alias("n_shared"))
    return shared.join(size1, "run1_cluster_id").join(size2, "run2_cluster_id").select(
        "run1_cluster_id", "run2_cluster_id", "n_run1", "n_run2", "n_shared")


def exact_clusters(clusters1, clusters2, by_members=False):
    """Clusters with the same members; also under the same id unless `by_members`."""
    same = cluster_overlap(clusters1, clusters2).where("n_shared = n_run1 and n_shared = n_run2")
    return same if by_members else same.where("run1_cluster_id = run2_cluster_id")


def partial_clusters(clusters1, clusters2):
    """Cluster pairs that share a member but not all members."""
    return cluster_overlap(clusters1, clusters2).where("not (n_shared = n_run1 and n_shared = n_run2)")


def dist_comparison(pairs1, pairs2, clusters1, clusters2):
    """Probability and cluster-size distributions of both runs."""
    parts = []
    for name, pairs, clusters in (("Run 1", pairs1, clusters1), ("Run 2", pairs2, clusters2)):
        prob = edge_metrics.match_prob_hist(pairs).select(
            F.lit(name).alias("run"), F.lit("probability").alias("distribution"),
            F.col("prob_bin").cast("double").alias("bin"), F.col("n_edges").alias("n"))
        size = cluster_metrics.cluster_sizes(clusters).select(
            F.lit(name).alias("run"), F.lit("cluster_size").alias("distribution"),
            F.col("n_nodes").cast("double").alias("bin"), F.col("n_clusters").alias("n"))
        parts += [prob, size]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gamma_comparison(pairs1, pairs2):
    """Mean gammas of the comparisons both runs have."""
    common = sorted(set(edge_metrics.gamma_columns(pairs1)) & set(edge_metrics.gamma_columns(pairs2)))
    one = edge_metrics.gamma_means(pairs1, common) if common else edge_metrics.gamma_means(pairs1.limit(0).select("unique_id_l"))
    two = edge_metrics.gamma_means(pairs2, common) if common else one.limit(0)
    return labelled_runs(one, two)


def inter_metrics(pairs1, pairs2, clusters1, clusters2, records=None):
    """Headline comparison of two runs as (metric, value) rows. Pairs of folded rows over the same `records` are not unfolded."""
    edges = edge_diff(pairs1, pairs2, records).select(F.concat(F.col("category"), F.lit("_edges")).alias("metric"), F.col("n").cast("double").alias("value"))
    probs = prob_comparison(pairs1, pairs2)
    suffix = F.when(F.col("run") == "Run 1", "run1").otherwise("run2")
    prob_rows = probs.select(F.explode(F.array(*[
        F.struct(F.concat(F.lit(f"{m}_"), suffix).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in ("mean_match_prob", "median_match_prob", "n_edges")])).alias("x")).select("x.*")
    same = F.expr("n_shared = n_run1 and n_shared = n_run2")
    row = cluster_overlap(clusters1, clusters2).agg(
        F.count_if(same & F.expr("run1_cluster_id = run2_cluster_id")).alias("n_exact_matching_clusters"),
        F.count_if(~same).alias("n_partial_matching_clusters"))
    names = ("n_exact_matching_clusters", "n_partial_matching_clusters")
    cluster_rows = _rows(row, [(F.lit(n), F.col(n).cast("double")) for n in names], "metric string, value double")
    return edges.unionByName(prob_rows).unionByName(cluster_rows)


def recluster_delta(records, pairs, filtered, clusters, threshold=0.8):
    """What a filter on the pair table does to edges and clusters."""
    new = cluster_pairs(records, filtered, threshold)
    kept = pairs.select(*FULL_KEYS).join(filtered.select(*FULL_KEYS), FULL_KEYS, "left_semi")
    counts = [
        ("edges_original", pairs.agg(F.count("*").alias("v"))),
        ("edges_retained", kept.agg(F.count("*").alias("v"))),
        ("clusters_original", cluster_metrics.n_clusters(clusters).select(F.col("n_clusters").alias("v"))),
        ("clusters_after", cluster_metrics.n_clusters(new).select(F.col("n_clusters").alias("v"))),
    ]
    row = None
    for name, one in counts:
        one = one.select(F.lit(1).alias("_one"), F.col("v").alias(name))
        row = one if row is None else row.join(F.broadcast(one), "_one")
    cells = [(F.lit(n), F.col(n)) for n, _ in counts]
    cells.append((F.lit("edges_removed"), F.col("edges_original") - F.col("edges_retained")))
    cells.append((F.lit("cluster_delta"), F.col("clusters_after") - F.col("clusters_original")))
    return _rows(row, cells, "metric string, value long")


def config_diff(config1, config2):
    """What changed between two run configurations, as (section, key, run1, run2) tuples."""
    rows = []

    def changed(section, one, two):
        for name in sorted(two - one):
            rows.append((section, name, "no", "yes"))
        for name in sorted(one - two):
            rows.append((section, name, "yes", "no"))

    changed("fields", set(config1.get("selected_fields", [])), set(config2.get("selected_fields", [])))
    on = lambda c: {k for k, v in c.get("blocking_toggles", {}).items() if v}
    changed("blocking_rules", on(config1), on(config2))
    for key in ("blocking_mode", "linkage_type", "cluster_threshold"):
        if config1.get(key) != config2.get(key):
            rows.append(("settings", key, str(config1.get(key)), str(config2.get(key))))
    return rows


def run_diff(spark, config1, config2, results1, results2):
    """Configuration changes, then result deltas: (section, key, run1, run2, delta).

    `results` are one-row tables with the same numeric columns.
    """
    schema = "section string, key string, run1 string, run2 string, delta double"
    config = spark.createDataFrame([r + (None,) for r in config_diff(config1, config2)], schema)
    names = [c for c in results1.columns if c in results2.columns]
    one = results1.select(*[F.col(c).alias(f"{c}_1") for c in names], F.lit(1).alias("_one"))
    two = results2.select(*[F.col(c).alias(f"{c}_2") for c in names], F.lit(1).alias("_one"))
    row = one.join(F.broadcast(two), "_one")
    cells = [(F.lit("results"), F.lit(c), F.col(f"{c}_1").cast("string"), F.col(f"{c}_2").cast("string"),
              rounded((F.col(f"{c}_2") - F.col(f"{c}_1")).cast("double"), 4)) for c in names]
    return config.unionByName(_rows(row, cells, schema))
