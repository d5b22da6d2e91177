"""Metrics of a cluster table."""
from pyspark.sql import functions as F

from kinsift.functions.numbers import rounded
from kinsift.operators.blocking import node


def n_clusters(clusters):
    return clusters.select("cluster_id").distinct().agg(F.count("*").alias("n_clusters"))


def nodes_per_cluster(clusters):
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("n_nodes"))


def cluster_sizes(clusters):
    return nodes_per_cluster(clusters).groupBy("n_nodes").agg(F.count("*").alias("n_clusters")).orderBy("n_nodes")


def singleton_vs_multi(clusters):
    kind = F.when(F.col("n_nodes") == 1, "Singleton (1 record)").otherwise("Multi-record cluster (2+ records)")
    return (cluster_sizes(clusters).groupBy(kind.alias("cluster_type"))
            .agg(F.sum("n_clusters").alias("n_clusters"), F.sum(F.col("n_nodes") * F.col("n_clusters")).alias("total_records"))
            .orderBy("cluster_type"))


def source_membership(clusters):
    return (clusters.select("source_dataset", "cluster_id").distinct().groupBy("source_dataset")
            .agg(F.count("*").alias("n_clusters_containing_dataset")).orderBy("source_dataset"))


def _sources(clusters):
    return clusters.groupBy("cluster_id").agg(
        F.max(F.coalesce(F.col("source_dataset") == "A", F.lit(False))).alias("has_a"),
        F.max(F.coalesce(F.col("source_dataset") == "B", F.lit(False))).alias("has_b"),
        F.min("source_dataset").alias("first_source"), F.max("source_dataset").alias("last_source"))


def source_overlap(clusters):
    """Clusters with records of A only, of B only, and of both."""
    return _sources(clusters).agg(
        F.count_if(F.expr("has_a and not has_b")).alias("a_only"),
        F.count_if(F.expr("has_b and not has_a")).alias("b_only"),
        F.count_if(F.expr("has_a and has_b")).alias("both_ab"))


def cross_dataset_clusters(clusters):
    """Clusters with more than one source."""
    return _sources(clusters).where("first_source <> last_source").agg(F.count("*").alias("n_cross_dataset_clusters"))


def cluster_stats(clusters):
    """Summary of cluster sizes, from one row per size."""
    sizes = cluster_sizes(clusters)
    multi = F.sum(F.when(F.col("n_nodes") > 1, F.col("n_clusters")).otherwise(F.lit(0)))
    return sizes.agg(
        rounded(F.sum(F.col("n_nodes") * F.col("n_clusters")) / F.sum("n_clusters"), 2).alias("mean_cluster_size"),
        F.max("n_nodes").alias("max_cluster_size"),
        F.expr("percentile(n_nodes, 0.5D, n_clusters)").alias("median_cluster_size"),
        multi.alias("multi_member_clusters"),
        rounded(F.lit(100.0) * multi / F.sum("n_clusters"), 2).alias("pct_multi_member"))


def value_breakdown(clusters, column):
    """Frequency and share of the values of a column, nulls left out."""
    counts = clusters.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_records"), F.lit(1).alias("_one"))
    total = counts.agg(F.sum("n_records").alias("_total"), F.lit(1).alias("_one"))      # one row
    share = F.lit(100.0) * F.col("n_records") / F.col("_total")
    return (counts.join(F.broadcast(total), "_one").select(column, "n_records", rounded(share, 1).alias("pct"))
            .orderBy(F.desc("n_records"), column))


def with_linked_flag(clusters):
    """Records with linked = their cluster has more than one record.

    A cluster is named after its smallest record. Any other record of it is linked, which needs no join; only the records that name a
    cluster, one each, are joined with the names of the clusters that have others. Without that naming, sizes are joined.
    """
    if not {"source_dataset", "unique_id"} <= set(clusters.columns):
        sizes = nodes_per_cluster(clusters).select("cluster_id", (F.col("n_nodes") > 1).alias("linked"))
        return clusters.join(sizes, "cluster_id")
    head = F.coalesce(node() == F.col("cluster_id"), F.lit(False))
    others = clusters.select("cluster_id", head.alias("head")).groupBy("cluster_id").agg(
        F.count_if("head").alias("heads"), F.count_if(~F.col("head")).alias("rest")).where("heads > 1 OR heads = 1 AND rest > 0 OR heads = 0 AND rest = 1")
    # Clusters of one record that does not name it are flagged by name too, so that other namings give the same flags.
    heads = clusters.where(head).join(others.where("heads > 0").select("cluster_id", F.lit(True).alias("linked")), "cluster_id", "left")
    rest = clusters.where(~head).join(others.where("heads = 0").select("cluster_id", F.lit(False).alias("alone")), "cluster_id", "left")
    return (heads.withColumn("linked", F.coalesce("linked", F.lit(False)))
            .unionByName(rest.withColumn("linked", F.coalesce("alone", F.lit(True))).drop("alone")))


def linked_unlinked(clusters):
    flagged = with_linked_flag(clusters)
    return flagged.where("linked").drop("linked"), flagged.where("not linked").drop("linked")
