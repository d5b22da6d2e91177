"""Report tables: the rows behind a run report."""
from pyspark.sql import functions as F

from kinsift.operators import cluster_metrics, demographics, edge_metrics
from kinsift.operators.scoring import model_params, prior_log_odds


def match_weight_table(spark, model):
    """Prior row, then one row per usable level."""
    prior = spark.createDataFrame([("Prior", "Prior", prior_log_odds(model["probability_two_random_records_match"]))],
                                  "field string, label string, match_weight double")
    levels = model_params(spark, model).where("match_weight is not null").select("field", "label", "match_weight")
    return prior.unionByName(levels)


def parameter_estimates(spark, model):
    """m of every usable level as log odds."""
    rows = model_params(spark, model).where("not is_null and m_prob > 0 and m_prob < 1")
    return rows.select("field", "level", "label", F.log2(F.col("m_prob") / (1 - F.col("m_prob"))).alias("log_odds"))


def comparison_levels(spark, model):
    """Field, level order, condition and null flag."""
    return model_params(spark, model).select("field", "level", "label", "condition", "is_null")


def _metric(name, df, column):
    return df.select(F.lit(name).alias("metric"), F.col(column).cast("double").alias("value"))


def _unpivot_row(df, prefix=""):
    cells = [F.struct(F.lit(prefix + c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns]
    return df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def _union(parts):
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def intra_metrics(pairs, clusters, link=False):
    """All scalar metrics of one run as (metric, value) rows. Hand in cached or checkpointed inputs."""
    parts = [
        _metric("n_edges", edge_metrics.n_edges(pairs), "n_edges"),
        _unpivot_row(edge_metrics.match_prob_stats(pairs)),
        _unpivot_row(edge_metrics.weight_percentiles(pairs), "match_weight_"),
        _metric("n_clusters", cluster_metrics.n_clusters(clusters), "n_clusters"),
        _metric("n_cross_dataset_clusters", cluster_metrics.cross_dataset_clusters(clusters), "n_cross_dataset_clusters"),
        _unpivot_row(cluster_metrics.source_overlap(clusters)),
        _unpivot_row(edge_metrics.linkage_rate(pairs, clusters).select("n_unique_ids_with_edge", "linkage_rate")),
        _unpivot_row(cluster_metrics.cluster_stats(clusters)),
        _metric("reduction_ratio", edge_metrics.reduction_ratio(pairs, clusters, link), "reduction_ratio"),
    ]
    gammas = edge_metrics.gamma_columns(pairs)
    if gammas:
        means = edge_metrics.gamma_means(pairs, gammas)
        parts.append(means.select(F.concat(F.lit("mean_"), F.col("comparison")).alias("metric"), F.col("mean_gamma").alias("value")))
    return _union(parts)


def run_summary(spark, config, pairs, clusters, confusion=None, diagnostic=None, top=3):
    """Configuration, results, accuracy, zero-edge notes and top demographics as (section, key, value) rows."""
    on = sorted(k for k, v in config.get("blocking_toggles", {}).items() if v)
    off = sorted(k for k, v in config.get("blocking_toggles", {}).items() if not v)
    settings = [
        ("operation_mode", config.get("operation_mode", "unknown")), ("linkage_type", config.get("linkage_type", "unknown")),
        ("blocking_mode", config.get("blocking_mode", "OR")), ("cluster_threshold", str(config.get("cluster_threshold", "n/a"))),
        ("comparison_fields", ",".join(config.get("selected_fields", []))), ("active_rules", ",".join(on)),
        ("disabled_rules", ",".join(off))]
    hyper = config.get("hyperparams") or {}
    if config.get("linkage_type") == "probabilistic":
        settings += [(k, str(hyper[k])) for k in ("max_iterations", "em_convergence", "recall_estimate") if k in hyper]
    schema = "section string, key string, value string"
    parts = [spark.createDataFrame([("configuration", k, v) for k, v in settings], schema)]
    numbers = [
        _metric("n_input_records", clusters.agg(F.count("*").alias("n")), "n"), _metric("n_edges", edge_metrics.n_edges(pairs), "n_edges"),
        _metric("n_clusters", cluster_metrics.n_clusters(clusters), "n_clusters"),
        _unpivot_row(edge_metrics.linkage_rate(pairs, clusters).select("n_unique_ids_with_edge", "linkage_rate")),
        _metric("mean_match_prob", edge_metrics.match_prob_stats(pairs), "mean_match_prob")]
    as_text = lambda section, rows: rows.select(F.lit(section).alias("section"), F.col("metric").alias("key"),
                                                F.format_string("%.4f", F.col("value")).alias("value"))
    parts.append(as_text("results", _union(numbers)))
    if confusion is not None:
        parts.append(as_text("accuracy", _unpivot_row(confusion.select("precision", "recall", "f1", "fdr", "fnr"))))
    if diagnostic is not None:
        parts.append(diagnostic.where("issue is not null").select(
            F.lit("zero_edges").alias("section"), F.col("field").alias("key"), F.col("issue").alias("value")))
    best = demographics.top_per_field(demographics.demographic_snapshot(clusters), top)
    share = F.format_string("%.1f", F.col("pct"))
    parts.append(best.select(F.lit("demographics").alias("section"),
                             F.concat("field", F.lit("#"), F.col("rank").cast("string")).alias("key"),
                             F.concat("label", F.lit(": "), F.col("n_records").cast("string"), F.lit(" ("), share, F.lit("%)")).alias("value")))
    return _union(parts)


def export_cohort(records, clusters):
    """Records with their cluster id, by id and source; an id without a source match falls back to the id."""
    ids = clusters.select("unique_id", "source_dataset", "cluster_id")
    if "source_dataset" not in records.columns:
        first = ids.groupBy("unique_id").agg(F.min("cluster_id").alias("cluster_id"))
        return records.join(first, "unique_id", "left")
    return records.join(ids, ["unique_id", "source_dataset"], "left")


def export_stats(export):
    """Rows, distinct clusters and rows with a cluster."""
    return export.agg(F.count("*").alias("n_rows"), F.count_distinct("cluster_id").alias("n_clusters"),
                      F.count("cluster_id").alias("n_with_cluster"))


def cohort_preview(export, n=50):
    return export.orderBy("cluster_id", "unique_id").limit(n)
