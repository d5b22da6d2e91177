"""Clusters as connected components, by alternating large-star and small-star steps
(Kiveris et al., Connected Components in MapReduce and Beyond, 2014)."""
from pyspark.sql import functions as F

from kinsift.operators.blocking import node, ties
from kinsift.session import materialise, release

#: Edges of one node above which it is a hub, and hubs that are joined by broadcast at most: the largest ones. Any other node then has
#: less than a ten thousandth of all edges, or less than HOT_NODE.
HOT_NODE, HUBS = 1_000_000, 10_000


def _down(edges):
    """Edges as (hi, lo) with lo < hi, each once."""
    return (edges.where("node_l <> node_r")
            .select(F.greatest("node_l", "node_r").alias("hi"), F.least("node_l", "node_r").alias("lo")).distinct())


def _join_unique(edges, values, key, how, hottest, hot_node):
    """Join edges with a table that has one row per `key`.

    Keys met by more than `hot_node` edges are joined by broadcast, so no task receives all edges of one hub. They are at
    most HUBS rows, whatever the size of the graph.
    """
    if hottest <= hot_node:
        return edges.join(values, key, how)
    hubs = edges.groupBy(key).count().where(F.col("count") > hot_node).orderBy(F.desc("count"), key).limit(HUBS).select(key)
    hub_values = values.join(F.broadcast(hubs), key, "left_semi")
    hot = edges.join(F.broadcast(hubs), key, "left_semi").join(F.broadcast(hub_values), key, how)
    cold = edges.join(F.broadcast(hubs), key, "left_anti").join(values, key, how)
    return hot.unionByName(cold)


def _state(stars):
    """Most edges that meet at a low end and at a high end, and whether every component is a star
    already: no node is both a high and a low end, and no high end has two low ends. One aggregation,
    folded before its shuffle."""
    ends = stars.selectExpr("inline(array(named_struct('node', hi, 'up', 1L, 'down', 0L), named_struct('node', lo, 'up', 0L, 'down', 1L)))")
    row = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).agg(
        F.max("down").alias("down"), F.max("up").alias("up"),
        F.count_if(F.expr("up > 0 and down > 0")).alias("inner")).first()
    return (row["down"] or 0), (row["up"] or 0), (row["up"] or 0) <= 1 and (row["inner"] or 0) == 0


def component_labels(edges, hot_node=HOT_NODE, max_rounds=60):
    """(node, label) for every node that has an edge; label is the smallest node of its component."""
    stars = materialise(_down(edges))
    for _ in range(max_rounds):
        low_degree, high_degree, done = _state(stars)
        if done:
            break
        # Large star: hang every higher neighbour of a node under that node's lowest neighbour.
        lowest = stars.groupBy("hi").agg(F.min("lo").alias("low")).selectExpr("hi AS lo", "low")
        up = (_join_unique(stars, lowest, "lo", "left", low_degree, hot_node)
              .select("hi", F.coalesce("low", "lo").alias("lo")).distinct())
        # Small star: hang a node's lower neighbours, and the node itself, under the lowest of them.
        least = up.groupBy("hi").agg(F.min("lo").alias("low"))
        moved = _join_unique(up, least, "hi", "inner", high_degree, hot_node).where("lo <> low").selectExpr("lo AS hi", "low AS lo")
        before, stars = stars, materialise(moved.unionByName(least.selectExpr("hi", "low AS lo")).distinct())
        release(before)
    else:
        raise RuntimeError("components did not settle")
    heads = stars.selectExpr("lo AS node").distinct().selectExpr("node", "node AS label")
    return stars.selectExpr("hi AS node", "lo AS label").unionByName(heads)


def cluster_records(records, edges, hot_node=HOT_NODE):
    """All records with a cluster_id; a record without an edge is its own cluster."""
    labels = component_labels(edges, hot_node)
    keyed = records.withColumn("node", node())
    return (keyed.join(labels, "node", "left")
            .withColumn("cluster_id", F.coalesce("label", "node")).drop("node", "label"))


def edges_of(pairs, threshold=0.8):
    return ties(pairs.where(F.col("match_probability") >= F.lit(float(threshold))))


def cluster_pairs(records, pairs, threshold=0.8):
    """Cluster records by the pairs whose probability reaches the threshold."""
    return cluster_records(records, edges_of(pairs, threshold))
