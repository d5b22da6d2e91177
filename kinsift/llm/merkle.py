"""Merkle manifest of a dataset by butterfly exchange.

Leaves are ranked per source without bringing a source into one task: a range sort, then running counts of its runs. Chunks of
fanout ** inner_levels consecutive leaves hash their own subtree. Then, round by round, chunks whose numbers differ in one digit
to the base of the fanout swap the nodes that stand over them, and each hashes the ancestor for itself. After the last round
every chunk has the root and all upper siblings of its leaves, so nothing is passed down. A round ships at most `fanout`
digests a chunk. The same exchange over sources gives the root of the whole.

Where a level's last node has fewer chunks under it than its neighbours, its chunks send for the missing ones: a chunk
serves all places that equal its own modulo the number of chunks under the node.
"""
import hashlib

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinsift.llm.common import arrow_rows
from kinsift.session import materialise, release

#: Fixed by the contract of the query: children of a node, and the fields of a leaf in order.
FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one chunk hashes by itself: 16 ** 3 = 4096 leaves, some 400 KB.
INNER_LEVELS = 3
PATH = "array<struct<before:string,after:string>>"


def leaf_digest(columns):
    """H of the fields: `-` for a null, else the number of UTF-8 bytes, a colon, and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def ranked(df, group, order):
    """`df`, stored, with rank (from 0, inside the group) and group_rows.

    Rows are range sorted; a group's place in each partition is its running count over the partitions before. That window
    has one row per partition and group, never the rows themselves. Equal rows are split between partitions too.
    """
    by = [*group, *order]
    seated = materialise(df.repartitionByRange(*by, "spread").sortWithinPartitions(*by).drop("spread").withColumn("seat", F.monotonically_increasing_id()))
    part = F.shiftright("seat", 33)
    runs = seated.groupBy(*group, part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("seat").alias("first"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*group, "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                       F.sum("n").over(Window.partitionBy(*group)).alias("group_rows"))
    return (seated.withColumn("part", part).join(runs, [*group, "part"])
            .withColumn("rank", F.col("seat") + F.col("shift")).drop("seat", "part", "shift")), seated


def _exchange(state, level, fanout):
    """One round: every member gets the nodes of its run at this level, keeps its siblings and hashes the parent."""
    width = fanout ** level
    size = F.ceil(F.col("n") / width)
    q, low = F.expr(f"idx div {width}"), F.col("idx") % width
    under = lambda node: F.least(F.lit(width), F.col("n") - node * width)
    first = F.expr(f"idx div {width * fanout}") * fanout
    sent = state.select("grp", "idx", "n", "node", "path", q.alias("q"), low.alias("low"), under(q).alias("members"),
                        F.explode(F.sequence(first, F.least(first + fanout - 1, size - 1))).alias("to"))
    sent = sent.where(F.col("low") < under(F.col("to")))
    places = F.when(F.col("to") == F.col("q"), F.array("low")).otherwise(F.sequence(F.col("low"), under(F.col("to")) - 1, F.col("members")))
    sent = (sent.select("grp", "idx", "n", "node", "path", "q", "to", F.explode(places).alias("place"))
            .withColumn("target", F.col("to") * width + F.col("place")))
    own = F.when(F.col("target") == F.col("idx"), F.col("path"))
    met = sent.groupBy("grp", F.col("target").alias("idx"), "n").agg(
        F.sort_array(F.collect_list(F.struct("q", "node"))).alias("run"), F.max(own).alias("path"))
    text = lambda nodes: F.array_join(F.transform(nodes, lambda x: x["node"]), "")
    step = F.struct(text(F.filter("run", lambda x: x["q"] < q)).alias("before"), text(F.filter("run", lambda x: x["q"] > q)).alias("after"))
    done = size <= 1
    return met.select("grp", "idx", "n", F.when(done, F.get("run", F.lit(0))["node"]).otherwise(F.sha2(text(F.col("run")), 256)).alias("node"),
                      F.when(done, F.col("path")).otherwise(F.concat("path", F.array(step))).alias("path"))


def butterfly(nodes, fanout=FANOUT):
    """(grp, idx, n, node, path): `nodes` (grp, idx 0.. n - 1, n, node) with the group's root as node, and the siblings
    before and after on every level up to it. A group of one node is its own root. Not more than log(n) rounds."""
    state = materialise(nodes.select("grp", F.col("idx").cast("long").alias("idx"), F.col("n").cast("long").alias("n"), "node",
                                     F.array().cast(PATH).alias("path")))
    largest = state.agg(F.max("n")).first()[0] or 0
    level = 0
    while fanout ** level < largest:
        before, state = state, materialise(_exchange(state, level, fanout))
        release(before)
        level += 1
    return state


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold_chunk(leaves, found, inner, fanout, upper):
    """For each leaf of a chunk: (digest of its siblings up to the root, root recomputed from `found`).

    `inner` is the number of levels hashed here, `upper` the siblings above as (before, after).
    """
    levels = [leaves]
    for _ in range(inner):
        levels.append([_h("".join(levels[-1][i:i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    out = []
    for i, digest in enumerate(found):
        proof, at = hashlib.sha256(), i
        path = []
        for nodes in levels[:-1]:
            start = at - at % fanout
            path.append(("".join(nodes[start:at]), "".join(nodes[at + 1:start + fanout])))
            at //= fanout
        for before, after in [*path, *upper]:
            proof.update((before + after).encode())
            digest = _h(before + digest + after)
        out.append((proof.hexdigest(), digest))
    return out


def manifest(documents, doc_id="doc_id", source="source", fields=FIELDS, found=None, fanout=FANOUT, inner_levels=INNER_LEVELS):
    """Per row of `documents`: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified.

    `found` maps a field to the column expression that was found in its place later (null or absent: as it was); folded_root
    is recomputed from the leaf of what was found and the original siblings, and verified says whether it equals root.
    Nulls in any field are a `-`; a null source is a source of its own and first, null ids come first in theirs; rows of
    one id are separate leaves in the order of their digests; an empty table gives an empty one; texts of any length are
    hashed whole; other columns are not looked at, whatever their names.
    """
    spark = documents.sparkSession
    original = leaf_digest([F.col(f) for f in fields])
    later = leaf_digest([F.coalesce(found[f], F.col(f)) if f in (found or {}) else F.col(f) for f in fields])
    changed = F.lit(False)
    for column in (found or {}).values():
        changed = changed | column.isNotNull()
    # A null source is the empty key, any other begins with `=`: nulls come first and keys join like any text.
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    leaves = documents.select(key.alias("src"), F.col(doc_id).alias("id"), original.alias("leaf"), F.when(changed, later).alias("found"),
                              F.monotonically_increasing_id().alias("spread"))
    ordered, seated = ranked(leaves, ["src"], ["id", "leaf"])
    span = fanout ** inner_levels
    n_chunks = F.ceil(F.col("group_rows") / span)
    chunks = materialise(ordered.groupBy("src", "group_rows", F.expr(f"rank div {span}").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "leaf", "found"))).alias("rows")))
    release(seated)

    def up(nodes):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int")),
                           lambda i: F.sha2(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), ""), 256))

    # Subtree roots: a chunk among others goes up all inner levels, a source's only chunk until one node is left.
    roots = chunks.select("src", "chunk", "group_rows", F.transform("rows", lambda r: r["leaf"]).alias("nodes"))
    for _ in range(inner_levels):
        roots = roots.withColumn("nodes", F.when((n_chunks > 1) | (F.size("nodes") > 1), up(F.col("nodes"))).otherwise(F.col("nodes")))
    in_source = butterfly(roots.select(F.col("src").alias("grp"), F.col("chunk").alias("idx"), n_chunks.alias("n"), F.get("nodes", F.lit(0)).alias("node")), fanout)

    sources = in_source.where("idx = 0").select(F.lit(0).alias("all"), F.col("grp").alias("src"), "node", F.lit(0).alias("spread"))
    placed, seats = ranked(sources, ["all"], ["src"])
    numbered = materialise(placed.select("src", "rank", "group_rows", "node"))
    release(seats)
    over = butterfly(numbered.select(F.lit(0).alias("grp"), F.col("rank").alias("idx"), F.col("group_rows").alias("n"), "node"), fanout)
    of_source = numbered.join(over.select(F.col("idx").alias("rank"), F.col("node").alias("root"), F.col("path").alias("source_path")), "rank").select(
        "src", F.col("node").alias("subroot"), "root", "source_path")

    told = (chunks.join(in_source.select(F.col("grp").alias("src"), F.col("idx").alias("chunk"), F.col("path").alias("chunk_path")), ["src", "chunk"])
            .join(of_source, "src")
            .select(F.when(F.col("src") != "", F.expr("substr(src, 2)")).alias("source"), (n_chunks > 1).alias("many"), "rows", "subroot", "root",
                    F.concat("chunk_path", "source_path").alias("upper")))
    id_type = documents.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def fold(batches):
        names = [part.split(" ")[0] for part in schema.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                own = [r["leaf"] for r in row["rows"]]
                inner, left = 0, len(own)
                while inner < inner_levels and (row["many"] or left > 1):
                    inner, left = inner + 1, -(-left // fanout)
                proofs = fold_chunk(own, [r["found"] or r["leaf"] for r in row["rows"]], inner, fanout, [(p["before"], p["after"]) for p in row["upper"]])
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["id"] for r in row["rows"]], out_type), pa.array([row["source"]] * len(own), pa.string()), pa.array(own, pa.string()),
                    pa.array([row["subroot"]] * len(own), pa.string()), pa.array([row["root"]] * len(own), pa.string()),
                    pa.array([p for p, _ in proofs], pa.string()), pa.array([f for _, f in proofs], pa.string()),
                    pa.array([f == row["root"] for _, f in proofs], pa.bool_())], names)

    from pyspark.sql.pandas.types import to_arrow_type
    out_type = to_arrow_type(documents.schema[doc_id].dataType)
    with arrow_rows(spark, 16):
        result = materialise(told.mapInArrow(fold, schema))
    for table in (chunks, in_source, numbered, over):
        release(table)
    return result
