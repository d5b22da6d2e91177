"""The same operators over the supplied tables' own columns."""
from pyspark.sql import functions as F

from kinsift.operators import blocking, cluster_metrics, cohort, components, profiling
from queries import fixtures as x
from queries.fixtures import q_round, q_with
from queries.registry import query

EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value", "props"]


@query("completeness_events", " UNION ALL ".join(
    f"SELECT '{c}' AS field, {q_round(f'100.0::DOUBLE * count({c}) / count(*)', 1)} AS pct_complete FROM events" for c in EVENT_COLUMNS))
def completeness_events(spark, sf_dir):
    return profiling.completeness(x.load(spark, sf_dir, "events"), EVENT_COLUMNS)


@query("top_categories_events", "SELECT event_type AS value, count(*) AS n_records FROM events GROUP BY 1 ORDER BY n_records DESC, value LIMIT 10")
def top_categories_events(spark, sf_dir):
    return profiling.top_categories(x.load(spark, sf_dir, "events"), "event_type", 10)


@query("value_breakdown_lines", f"""SELECT l_returnflag, count(*) AS n_records, {q_round('100.0::DOUBLE * count(*) / (sum(count(*)) OVER ())', 1)} AS pct
  FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def value_breakdown_lines(spark, sf_dir):
    return cluster_metrics.value_breakdown(x.load(spark, sf_dir, "lineitem"), "l_returnflag")


LINE_COLUMNS = ["l_linenumber", "l_discount", "l_tax", "l_quantity", "l_suppkey"]


@query("column_agreement_lines", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, avg(coalesce(({a}::VARCHAR = {b}::VARCHAR)::INT, 0)::DOUBLE) AS share FROM lines"
    for i, a in enumerate(LINE_COLUMNS) for b in LINE_COLUMNS[i + 1:]).join(["WITH lines AS (SELECT l_linenumber, (l_discount * 100)::INT AS l_discount, (l_tax * 100)::INT AS l_tax, l_quantity::INT AS l_quantity, l_suppkey FROM lineitem) ", ""])
    + ") WHERE share > 0.05")
def column_agreement_lines(spark, sf_dir):
    lines = x.load(spark, sf_dir, "lineitem").select("l_linenumber", F.round(F.col("l_discount") * 100).cast("int").alias("l_discount"),
                                                     F.round(F.col("l_tax") * 100).cast("int").alias("l_tax"), F.col("l_quantity").cast("int").alias("l_quantity"), "l_suppkey")
    return profiling.column_agreement(lines.select(*[F.col(c).cast("string").alias(c) for c in LINE_COLUMNS]), minimum=0.05)


TURN_RULES = [["body"], ["role", "n_chars", "turn"]]
Q_TURNS = """turns AS (SELECT conv_id || ':' || turn AS unique_id, 'A' AS source_dataset, md5(text) AS body, role, length(text)::INT AS n_chars, turn FROM conversations)"""


def turn_records(spark, sf_dir):
    return x.load(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("unique_id"), F.lit("A").alias("source_dataset"), F.md5("text").alias("body"), "role",
        F.length("text").alias("n_chars"), "turn")


@query("block_turns", q_with(Q_TURNS) + x.q_pairs("turns", TURN_RULES, []))
def block_turns(spark, sf_dir):
    """Turns with the same text, or the same role, place and length."""
    return blocking.candidate_pairs(turn_records(spark, sf_dir), TURN_RULES, [])


@query("cluster_events", """SELECT 'A-' || event_id AS node, min('A-' || event_id) OVER (PARTITION BY user_id, event_type, props) AS cluster_id FROM events
  WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND props IS NOT NULL""")
def cluster_events(spark, sf_dir):
    """Events of one user, kind and content are one entity."""
    events = x.load(spark, sf_dir, "events").dropna(subset=["user_id", "event_type", "props"]).select(
        F.col("event_id").cast("string").alias("unique_id"), F.lit("A").alias("source_dataset"), "user_id", "event_type", "props")
    links = blocking.deterministic_links(events, [["user_id", "event_type", "props"]], ["user_id", "event_type"])
    return components.cluster_records(events, links).select(blocking.node().alias("node"), "cluster_id")


@query("candidate_count_lines", """SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT - (SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT FROM
  (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity, l_orderkey)) AS n_pairs FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity)""")
def candidate_count_lines(spark, sf_dir):
    lines = x.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("unique_id"), F.lit("A").alias("source_dataset"), "l_suppkey", "l_quantity")
    return blocking.candidate_count(lines, [["l_suppkey", "l_quantity"]])
