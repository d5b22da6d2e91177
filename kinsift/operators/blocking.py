"""Candidate pairs from blocking rules.

A rule is a list of fields that must all be equal (null never equals anything). All rules share one
equi-join; a pair found by several rules is emitted once, by the first of them. Blocks larger than
`hot_block` records are cut into tiles so that no task ever holds a whole hot block: a record of a
block with c chunks belongs to one chunk and meets each of the c chunks in a tile of its own. Small
chunks are shuffled as one row each and meet in the join.
"""
from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from kinsift.functions.groups import cutter
from kinsift.functions.numbers import pairs_of
from kinsift.functions.orders import ordered_pairs
from kinsift.session import many_tasks

#: Records of a block that one tile holds on a side: at most four million pairs, whatever the block.
HOT_BLOCK = 2_000
#: Records that one row stands for at most when records are folded.
MEMBERS = 500


def node(source="source_dataset", uid="unique_id"):
    """Identity of a record across sources; pairs are ordered by it as text."""
    return F.concat(F.col(source), F.lit("-"), F.col(uid))


def parse_rule(key):
    """'a+b' -> ['a', 'b']"""
    return [part.strip() for part in key.split("+") if part.strip()]


def rules_from_toggles(toggles, mode="OR"):
    """Enabled rules in order. AND mode folds them all into one rule."""
    enabled = [key for key, on in toggles.items() if on]
    rules = [parse_rule(key) for key in enabled]
    if mode == "AND" and rules:
        rules = [list(dict.fromkeys(part for rule in rules for part in rule))]
    rules = [rule for rule in rules if rule]
    if not rules:
        raise ValueError("At least one blocking rule must be enabled.")
    return rules


def rule_sql(rule):
    return getattr(rule, "text", None) or " AND ".join(f'l."{f}" = r."{f}"' for f in rule)


def covers(fields):
    """True when all fields are present and equal on both sides, never null."""
    return F.expr("coalesce(" + " AND ".join(f"`{f}_l` = `{f}_r`" for f in fields) + ", false)")


class Rule(list):
    """A rule as a list of key columns, with what else must hold of a pair: SQL over <column>_l and <column>_r.

    A rule with an OR has no column that all its pairs share; its `alternatives` are lists of key columns of which each of
    its pairs shares one.
    """

    def __init__(self, fields, residual=None, needs=(), alternatives=None, text=None):
        super().__init__(fields)
        self.residual, self.needs, self.alternatives, self.text = residual, list(needs), alternatives or [list(fields)], text


def residual(rule):
    return getattr(rule, "residual", None)


def join_keys(rules):
    """Lists of key columns that find every pair of the rules."""
    return [list(keys) for rule in rules for keys in getattr(rule, "alternatives", [rule])]


def _first_cover(rules):
    """Index of the first rule whose fields are all equal on both sides and whose further test holds."""
    steps = " ".join("WHEN {} THEN {}".format(" AND ".join(
        [f"`{f}_l` = `{f}_r`" for f in rule] + ([f"({residual(rule)})"] if residual(rule) else [])), i) for i, rule in enumerate(rules))
    return F.expr(f"CASE {steps} END")


def _wider(spark, x, y):
    """The type in which Spark compares a column of type x with one of type y, taken from its own analysis; text gives way to the other."""
    kind = lambda t: "bigint" if t in ("tinyint", "smallint", "int", "bigint") else "double" if t in ("float", "double") or t.startswith("decimal") else t
    if "string" in (x, y):
        return kind(y if x == "string" else x)
    empty = spark.range(0)
    try:
        # The comparison itself must be allowed; two values of an array get the type that the comparison gives them.
        empty.where(F.lit(None).cast(x) == F.lit(None).cast(y))
        return empty.select(F.array(F.lit(None).cast(x), F.lit(None).cast(y)).alias("v")).schema["v"].dataType.elementType.simpleString()
    except AnalysisException as error:
        raise ValueError(f"values of type {x} and {y} cannot be compared") from error


def common_types(a, b):
    """Both tables with the columns they share in the type in which Spark compares them; columns that it does not compare are refused.

    A join key is hashed, and a hash tells an int 1 from a bigint 1, so this comes before any key is made. A text that
    is no value of the other side's type becomes null and matches nothing.
    """
    kinds_a, kinds_b = dict(a.dtypes), dict(b.dtypes)
    casts = {c: _wider(a.sparkSession, kinds_a[c], kinds_b[c]) for c in a.columns if kinds_b.get(c, kinds_a[c]) != kinds_a[c]}
    change = lambda df: df.withColumns({c: F.col(c).try_cast(t) if dict(df.dtypes)[c] == "string" else F.col(c).cast(t) for c, t in casts.items()}) if casts else df
    return change(a), change(b)


def both_tables(a, b):
    """All records of one or two tables, shared columns in one type."""
    if b is None:
        return a
    a, b = common_types(a, b)
    return a.unionByName(b, allowMissingColumns=True)


def _keyed(records, rules, carried):
    """One row per record and rule that has all its fields: rule number and hash of the key."""
    own = ["_members", "_first", "_last", "source_dataset"] if "_members" in records.columns else ["unique_id", "source_dataset"]
    columns = own + [f for f in carried if f not in ("unique_id", "source_dataset")]
    name = "_first" if "_members" in records.columns else "source_dataset || '-' || unique_id"
    keys = []
    for i, rule in enumerate(rules):
        there = " AND ".join(f"`{f}` IS NOT NULL" for f in rule)
        parts = ", ".join(f"`{f}`" for f in rule)
        keys.append(f"CASE WHEN {there} THEN named_struct('_rule', {i}, '_key', xxhash64({parts})) END")
    return records.selectExpr(
        *[f"`{c}`" for c in columns], f"{name} AS _node",
        f"inline(array_compact(array({', '.join(keys)})))")


def _hot(rows, hot_block, name):
    """Chunk count of every block above the limit. The list grows with the data, so it is joined as any table:
    Spark broadcasts it only while it is small."""
    sized = rows.groupBy("_rule", "_key").count().where(F.col("count") > hot_block)
    return sized.selectExpr("_rule", "_key", f"cast(ceil(count / {hot_block}) as int) AS {name}")


def _chunked(rows, hot, mine, met, hot_block):
    """One row for each chunk of about `hot_block` records of a block, with the records as `_rows`. Chunks lie in strips of HOT_BLOCK records, and a chunk is
    copied once for each strip that it meets, not for each chunk: the join makes the tiles."""
    per_strip, inside = HOT_BLOCK // hot_block, [c for c in rows.columns if c not in ("_rule", "_key")]
    values = ", ".join(f"`{c}`" for c in inside if c != "_members")
    dealt = rows.join(hot, ["_rule", "_key"], "left").withColumn("_chunk", F.expr(f"cast(pmod(xxhash64({values}), coalesce({mine}, 1)) as int)"))
    packed = dealt.groupBy("_rule", "_key", *dict.fromkeys([mine, met]), "_chunk").agg(F.collect_list(F.struct(*inside)).alias("_rows"))
    return packed.selectExpr("_rule", "_key", "_rows", f"cast(_chunk div {per_strip} as int) AS _mine",
                             f"explode(sequence(0, cast(ceil(coalesce({met}, 1) / {per_strip}) as int) - 1)) AS _meets")


def fold(records, fields, keep_null_ids=False, members=MEMBERS):
    """Records of one source with the same values as one row: the values, `_members` (the ids, at most about `members` in a row) and the first and
    last of their nodes."""
    columns = list(dict.fromkeys(["source_dataset", *fields]))
    quoted = [f"`{c}`" for c in columns]
    rows = records.selectExpr(*quoted, "unique_id", "source_dataset || '-' || unique_id AS _node", f"xxhash64({', '.join(quoted)}) AS _profile")
    if not keep_null_ids:
        rows = rows.where("_node IS NOT NULL")
    large = rows.groupBy("_profile").count().where(F.col("count") > members).selectExpr("_profile", f"cast(ceil(count / {members}) as int) AS _parts")
    dealt = rows.join(large, "_profile", "left").withColumn("_part", F.expr("cast(pmod(xxhash64(_node), coalesce(_parts, 1)) as int)"))
    return dealt.groupBy(*columns, "_part").agg(F.min("_node").alias("_first"), F.max("_node").alias("_last"),
                                                F.sort_array(F.collect_list(F.struct("unique_id"))).alias("_members")).drop("_part")


def folds_well(records, fields):
    """Whether at most two of three records differ in the fields, by an estimate of the distinct profiles."""
    if "unique_id" in fields:
        return False
    row = records.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("source_dataset", *fields)).alias("k")).first()
    return row["n"] > 1 and 3 * row["k"] <= 2 * row["n"]


def unfold(pairs):
    """The record pairs that pairs of folded rows stand for, with what `with_left` has put beside the ids; any other table of pairs as it is."""
    if "_members_l" not in pairs.columns:
        return pairs
    hidden = [f"{c}_{s}" for c in ("_members", "_first", "_last") for s in "lr"] + ["_ordered", "_n"]
    shown = [c for c in pairs.columns if c not in hidden]
    beside = [F.col(f"_l.{c}").alias(c) for c in pairs.schema["_members_l"].dataType.elementType.names if c != "unique_id"]
    both = pairs.select(*shown, "_ordered", "_members_r", F.explode("_members_l").alias("_l")).select(*shown, "_ordered", "_l", F.explode("_members_r").alias("_r"))
    # Of one source, ids are in the order of their nodes.
    inside = F.expr("""NOT _ordered OR CASE WHEN source_dataset_l = source_dataset_r THEN cast(_l.unique_id AS string) < cast(_r.unique_id AS string)
        ELSE source_dataset_l || '-' || _l.unique_id < source_dataset_r || '-' || _r.unique_id END""")
    return both.where(inside).select(F.col("_l.unique_id").alias("unique_id_l"), F.col("_r.unique_id").alias("unique_id_r"), *shown, *beside)


def with_left(pairs, values):
    """Pairs with the further columns of `values` (unique_id, source_dataset, ...) for their left record, as an inner join gives them. The members of a folded
    row are joined once, however many pairs it has, and `unfold` shows their values."""
    columns = [c for c in values.columns if c not in ("unique_id", "source_dataset")]
    if "_members_l" not in pairs.columns:
        return pairs.join(values.withColumnsRenamed({c: f"{c}_l" for c in ("unique_id", "source_dataset")}), ["unique_id_l", "source_dataset_l"])
    row = ["_row1", "_row2"]
    keyed = pairs.withColumns({c: F.xxhash64(F.lit(c), "source_dataset_l", "_members_l") for c in row})
    rows = keyed.select(*row, F.col("source_dataset_l").alias("source_dataset"), "_members_l").distinct()
    members = rows.select(*row, "source_dataset", F.explode("_members_l").alias("_m")).select(*row, "source_dataset", "_m.unique_id")
    known = members.join(values, ["unique_id", "source_dataset"]).groupBy(*row).agg(F.collect_list(F.struct("unique_id", *columns)).alias("_members_l"))
    # Few rows that many pairs are made of: their number of tasks is fixed.
    return keyed.drop("_members_l").repartition(many_tasks(pairs.sparkSession), *row).join(known, row).drop(*row)


def weighed(pairs):
    """The pairs with `_n`, the number of record pairs that a row stands for: what is counted needs no more. In the order of their nodes, each record
    of the right row pairs with those of the left row before it; a record is never paired with one of the same node. Only rows whose records
    lie among each other are looked at one by one."""
    if "_members_l" not in pairs.columns:
        return pairs.withColumn("_n", F.lit(1).cast("long"))
    plain = F.expr("""CASE WHEN NOT _ordered OR _last_l < _first_r THEN cast(size(_members_l) AS bigint) * size(_members_r)
        WHEN size(_members_l) = 1 AND size(_members_r) = 1 THEN 1L END""")
    # Of one source, ids are in the order of their nodes.
    nodes = lambda s: F.expr(f"""CASE WHEN _plain IS NULL AND source_dataset_l = source_dataset_r THEN cast(_members_{s}.unique_id AS array<string>)
        WHEN _plain IS NULL THEN transform(_members_{s}, m -> source_dataset_{s} || '-' || m.unique_id) END""")
    return pairs.withColumn("_plain", plain).withColumn("_among", ordered_pairs(nodes("l"), nodes("r"))).withColumn("_n", F.coalesce("_plain", "_among")).drop("_plain", "_among")


def counted(pairs):
    """How many record pairs a group of rows holds."""
    return F.coalesce(F.sum("_n"), F.lit(0)) if "_n" in pairs.columns else F.count("*")


def _row_of(side):
    """128 bits that tell a folded row of the pairs from any other."""
    return [F.xxhash64(F.lit(salt), f"source_dataset_{side}", f"_members_{side}").alias(salt) for salt in ("_row1", "_row2")]


def _row_members(pairs, side):
    """(_row1, _row2, node) of the records of the folded rows on a side of the pairs, a row once however many pairs it has."""
    rows = pairs.select(*_row_of(side), f"source_dataset_{side}", f"_members_{side}").distinct()
    return rows.select("_row1", "_row2", F.col(f"source_dataset_{side}").alias("source_dataset"), F.explode(f"_members_{side}").alias("_m")).select(
        "_row1", "_row2", "source_dataset", "_m.unique_id")


def _reached(pairs, side, each=None):
    """Records on a side of folded pairs with the record farthest before (for the right) or after (for the left) them that they pair with, as `_other`: once for a row and
    each value in the column `each`, however many pairs it has."""
    farthest = F.min("_first_l") if side == "r" else F.max("_last_r")
    known = pairs.select(*_row_of(side), "_first_l", "_last_r", "_ordered", *([F.explode(each).alias(each)] if each else [])).groupBy(
        "_row1", "_row2", "_ordered", *([each] if each else [])).agg(farthest.alias("_other"), F.min("_first_l").alias("_low"))
    found = known.join(_row_members(pairs, side), ["_row1", "_row2"]).withColumn("_node", node())
    return found.where("NOT _ordered OR _other < _node" if side == "r" else "NOT _ordered OR _node < _other")


def ends(pairs, *carried, sides="lr"):
    """The records on the wanted sides of the pairs, a folded row's once each: of the left row those before the last of the right, of the right row those
    after the first of the left."""
    if "_members_l" not in pairs.columns:
        parts = [pairs.select(F.col(f"unique_id_{s}").alias("unique_id"), F.col(f"source_dataset_{s}").alias("source_dataset"), *carried) for s in sides]
    elif not carried:
        parts = [_reached(pairs, s).select("unique_id", "source_dataset") for s in sides]
    else:
        inside = {"l": "NOT _ordered OR source_dataset || '-' || unique_id < _last_r", "r": "NOT _ordered OR source_dataset || '-' || unique_id > _first_l"}
        parts = [pairs.select(F.col(f"source_dataset_{s}").alias("source_dataset"), "_first_l", "_last_r", "_ordered", *carried, F.explode(f"_members_{s}").alias("_m"))
                 .select(F.col("_m.unique_id").alias("unique_id"), "source_dataset", "_first_l", "_last_r", "_ordered", *carried)
                 .where(inside[s]).select("unique_id", "source_dataset", *carried) for s in sides]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def ties(pairs, each=None):
    """Edges (node_l, node_r) that connect what the pairs connect, for each value in the array column `each` if it is named. Of a folded row, the records that have a pair
    are tied once to the farthest record that they pair with, which ties them to each other; so one edge for a pair of rows, from the first record of the
    left to the last of the right, connects the rest."""
    shown = [each] if each else []
    if "_members_l" not in pairs.columns:
        edges = pairs.select(node("source_dataset_l", "unique_id_l").alias("node_l"), node("source_dataset_r", "unique_id_r").alias("node_r"), *shown)
        return edges.withColumn(each, F.explode(each)) if each else edges
    between = pairs.select(F.col("_first_l").alias("node_l"), F.col("_last_r").alias("node_r"), *([F.explode(each).alias(each)] if each else []))
    right = _reached(pairs, "r", each).select(F.col("_other").alias("node_l"), F.col("_node").alias("node_r"), *shown)
    # Those of a left row all pair with the same record, so they are tied to the first of them: low centres settle in fewer rounds.
    left = _reached(pairs, "l", each).select(F.col("_low").alias("node_l"), F.col("_node").alias("node_r"), *shown)
    return between.unionByName(right).unionByName(left)


def paired(a, b, joins, carried, hot_block=HOT_BLOCK):
    """All pairs that share a join key, each once, with the fields of both sides as <f>_l and <f>_r.

    Records are read once and exploded to one row per key, so all rules share one shuffle, which the
    self-join reuses on both sides. Keys are hashed for the join; the residual test on the first rule
    that truly covers the pair makes the result exact and keeps a pair found by several rules once.
    """
    dedupe = b is None
    if not dedupe:
        a, b = common_types(a, b)
    left = _keyed(a, joins, carried)
    right = left if dedupe else _keyed(b, joins, carried)
    on, columns = ["_rule", "_key"], left.columns
    packed = hot_block and 2 * hot_block <= HOT_BLOCK
    if packed and dedupe:
        rows = left.where("_node IS NOT NULL")
        left = _chunked(rows, _hot(rows, hot_block, "_n"), "_n", "_n", hot_block).selectExpr(
            "*", "least(_mine, _meets) AS _tile1", "greatest(_mine, _meets) AS _tile2").drop("_meets")
        on += ["_tile1", "_tile2"]
    elif packed:
        hot = _hot(left, hot_block, "_na").join(_hot(right, hot_block, "_nb"), on, "full")
        left = _chunked(left, hot, "_na", "_nb", hot_block).withColumnsRenamed({"_mine": "_tile1", "_meets": "_tile2"})
        right = _chunked(right, hot, "_nb", "_na", hot_block).withColumnsRenamed({"_mine": "_tile2", "_meets": "_tile1"})
        on += ["_tile1", "_tile2"]
    elif hot_block and dedupe:
        # A record of a block with n chunks meets every chunk in the tile of the two chunk numbers.
        left = left.join(_hot(left, hot_block, "_n"), on, "left").selectExpr(
            "*", "cast(pmod(xxhash64(_node), coalesce(_n, 1)) as int) AS _mine",
            "explode(sequence(0, coalesce(_n, 1) - 1)) AS _meets")
        left = left.selectExpr("*", "least(_mine, _meets) AS _tile1", "greatest(_mine, _meets) AS _tile2").drop("_n", "_meets")
        on += ["_tile1", "_tile2"]
    elif hot_block:
        hot = _hot(left, hot_block, "_na").join(_hot(right, hot_block, "_nb"), on, "full")
        left = left.join(hot, on, "left").selectExpr(
            "*", "cast(pmod(xxhash64(_node), coalesce(_na, 1)) as int) AS _tile1", "explode(sequence(0, coalesce(_nb, 1) - 1)) AS _tile2")
        right = right.join(hot, on, "left").selectExpr(
            "*", "cast(pmod(xxhash64(_node), coalesce(_nb, 1)) as int) AS _tile2", "explode(sequence(0, coalesce(_na, 1) - 1)) AS _tile1")
        left, right = left.drop("_na", "_nb"), right.drop("_na", "_nb")
        on += ["_tile1", "_tile2"]
    # Records are few next to their pairs, and adaptive execution would put a small table into a few tasks: their number is fixed.
    left = left.repartition(many_tasks(a.sparkSession), *on)
    right = left if dedupe else right.repartition(many_tasks(a.sparkSession), *on)
    left = left.toDF(*[f"{c}_l" for c in left.columns])
    right = right.toDF(*[f"{c}_r" for c in right.columns])
    test = " AND ".join(f"{c}_l = {c}_r" for c in on)
    if dedupe and hot_block:
        test += " AND (_tile1_l = _tile2_l OR _mine_l <> _mine_r)"
    wanted = _first_cover([list(j) for j in joins]) == F.col("_rule_l")
    if dedupe:
        wanted = F.expr("_first_l < _last_r" if "_members" in a.columns else "_node_l < _node_r") & wanted
    if not packed:
        return left.join(right, F.expr(test) & wanted, "inner")
    tiles = left.join(right, F.expr(test), "inner").select("_rule_l", "_key_l", "_rows_r", F.explode("_rows_l").alias("_l")).select(
        "_rule_l", "_key_l", "_l", F.explode("_rows_r").alias("_r"))
    sides = [F.col(f"_{s}.`{c}`").alias(f"{c}_{s}") for s in "lr" for c in columns if c not in ("_rule", "_key")]
    return tiles.select("_rule_l", "_key_l", F.col("_rule_l").alias("_rule_r"), F.col("_key_l").alias("_key_r"), *sides).where(wanted)


def sharpen(rules, fields, at_least):
    """Rewrite rules so that agreement on `at_least` of `fields` is part of the join key.

    A pair kept by rule r agrees on r and on some subset of the fields that brings the count up to
    `at_least`, so joining on those composites finds the same pairs from far smaller blocks.
    """
    out = []
    for rule in join_keys(rules):
        missing = at_least - sum(1 for f in rule if f in fields)
        if missing <= 0:
            out.append(list(rule))
        else:
            spare = [f for f in fields if f not in rule]
            out += [list(rule) + list(extra) for extra in combinations(spare, missing)]
    kept = []
    for rule in out:
        if not any(set(other) <= set(rule) for other in kept):
            kept = [other for other in kept if not set(rule) <= set(other)] + [rule]
    return kept


def candidate_pairs(a, rules, fields, b=None, join_rules=None, hot_block=HOT_BLOCK, folded=False):
    """Each pair that satisfies at least one rule, once, with the index of the first such rule.

    `join_rules` may name a sharper set of composites (see `sharpen`) that covers the pairs wanted. `folded` gives pairs of folded rows where
    many records are alike (see `fold`), for what depends on the values alone; `unfold` makes the record pairs of them. Two rows come in
    both orders where records of either come first.
    """
    keys = join_rules or join_keys(rules)
    needed = list(dict.fromkeys([f for key in keys for f in key] + [f for rule in rules for f in [*rule, *getattr(rule, "needs", ())]] + list(fields)))
    kept = ["unique_id_l", "unique_id_r", "source_dataset_l", "source_dataset_r"]
    if folded:
        ordered, (a, b) = b is None, (a, None) if b is None else common_types(a, b)
        folded = folds_well(a, needed) or not ordered and folds_well(b, needed)
        if folded:
            a, b = fold(a, needed, not ordered), None if ordered else fold(b, needed, True)
            kept = ["source_dataset_l", "source_dataset_r", *[f"{c}_{s}" for c in ("_members", "_first", "_last") for s in "lr"], F.lit(ordered).alias("_ordered")]
    pairs = paired(a, b, keys, needed, hot_block)
    shown = [f"{f}_{s}" for f in needed if f not in ("unique_id", "source_dataset") for s in "lr"]
    out = pairs.select(*kept, _first_cover(rules).cast("int").alias("match_key"), *shown)
    return out.where("match_key IS NOT NULL") if any(residual(r) for r in rules) else out


def agreement_count(fields):
    """On how many of the fields both sides have the same value."""
    return F.expr(" + ".join(f"cast(coalesce(`{f}_l` = `{f}_r`, false) as int)" for f in fields))


def deterministic_pairs(a, rules, fields, b=None, hot_block=HOT_BLOCK, keep=()):
    """Pairs that satisfy a rule and agree on two compared fields (one if only one is compared)."""
    need = min(2 if len(fields) > 1 else 1, len(fields))
    carried = list(dict.fromkeys(list(fields) + list(keep)))
    pairs = candidate_pairs(a, rules, carried, b, join_rules=sharpen(rules, fields, need), hot_block=hot_block)
    return (pairs.where(agreement_count(fields) >= need)
            .withColumn("match_probability", F.lit(1.0))
            .withColumn("match_weight", F.lit(100.0)))


def deterministic_links(a, rules, fields, b=None):
    """Edges with the same connected components as `deterministic_pairs`, linear in the records.

    All records that share a composite key are tied to one leader of the block, instead of to each
    other. In link mode a block counts only when it holds records of both tables.
    """
    need = min(2 if len(fields) > 1 else 1, len(fields))
    both = both_tables(a, b)
    keys = []
    for i, rule in enumerate(sharpen(rules, fields, need)):
        there = " AND ".join(f"`{f}` IS NOT NULL" for f in rule)
        parts = ", ".join(f"cast(`{f}` as string)" for f in rule)
        keys.append(f"CASE WHEN {there} THEN to_json(array('{i}', {parts})) END")
    rows = both.selectExpr("source_dataset", "source_dataset || '-' || unique_id AS _node",
                           f"explode(array_compact(array({', '.join(keys)}))) AS _key")
    enough = "_n > 1" if b is None else "_s1 <> _s2"
    leaders = rows.groupBy("_key").agg(
        F.min("_node").alias("_leader"), F.count("*").alias("_n"),
        F.min("source_dataset").alias("_s1"), F.max("source_dataset").alias("_s2")).where(enough)
    # Leaders are joined by key: a plain equi-join, whose skewed partitions adaptive execution splits, for the leaders'
    # side has one row per key.
    found = rows.join(leaders.select("_key", F.col("_leader").alias("_to")), "_key")
    return found.where("_to <> _node").selectExpr("_node AS node_l", "_to AS node_r")


# ---- counting without making pairs -------------------------------------------------------------

def block_counts(records, rule, link=False):
    """Pairs of one rule from block sizes alone; a record is never paired with one of the same id."""
    counts = _pairs_per_set(records, list(dict.fromkeys(rule)), [list(dict.fromkeys(rule))], link)
    return counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_pairs"))


def _masked(rows, fields, masks, by=()):
    """(by, mask, n, na): how many records share all values of each mask's fields, for every mask in one aggregation.

    A row becomes one row per mask whose fields it has, keyed by 128 bits of hash: the exclusive or of the hashes of its values.
    Values are hashed once a row and the masks are one literal, so the plan is the same for ten masks and for ten thousand.
    """
    hashes = [F.when(F.col(f).isNotNull(), F.xxhash64(F.lit(f"{i}.{salt}"), F.col(f))).otherwise(F.lit(0)).alias(f"_h{salt}_{i}")
              for i, f in enumerate(fields) for salt in (1, 2)]
    there = F.lit(0).cast("long")
    for i, f in enumerate(fields):
        there = there.bitwiseOR(F.when(F.col(f).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    # A small table of profiles becomes very many rows, so it is dealt over all tasks first.
    spread = rows.select(*by, "n", "na", there.alias("_there"), *hashes).repartition(many_tasks(rows.sparkSession)).withColumn(
        "mask", F.explode(F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>")))

    def key(salt):
        out = F.lit(0).cast("long")
        for i in range(len(fields)):
            out = out.bitwiseXOR(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"_h{salt}_{i}")).otherwise(F.lit(0)))
        return out.alias(f"_k{salt}")

    return (spread.where(F.col("mask").bitwiseAND(F.col("_there")) == F.col("mask")).select(*by, "mask", key(1), key(2), "n", "na")
            .groupBy(*by, "mask", "_k1", "_k2").agg(F.sum("n").alias("n"), F.sum("na").alias("na")))


#: Sets of fields up to which a profile becomes one row per set; beyond, groups are cut field by field.
MANY_SETS = 64


def _cut_pairs(profiles, fields, order, masks, link, by=()):
    """(mask, c): pairs of records that share all fields of each mask, for very many masks.

    A mask belongs to its first field in `order`, which has those with most values first: a profile becomes one row per field that it has, with the hashes of the fields after it, and
    rows of one value meet in one task, which cuts them by the other fields. So a profile is shuffled at most once a field, however many masks there
    are, and a profile that no other one meets is looked at no further. Pairs inside a profile come from its count.
    """
    place = {f: i for i, f in enumerate(fields)}
    moved = lambda mask: sum(1 << k for k, f in enumerate(order) if mask >> place[f] & 1)
    back = {moved(mask): mask for mask in masks}
    hashed = F.array(*[F.when(F.col(f).isNotNull(), F.xxhash64(F.lit(f"{place[f]}"), f)) for f in order])
    rows = profiles.select(F.xxhash64(F.lit("by"), *by).alias("by"), "n", "na", hashed.alias("h")).repartition(many_tasks(profiles.sparkSession))
    leads = rows.select("by", "n", "na", "h", F.posexplode("h").alias("lead", "value")).where("value IS NOT NULL")
    dealt = leads.selectExpr("lead", "xxhash64(by, lead, value) AS group", "n", "na", f"slice(h, lead + 2, {len(order)}) AS after").repartition(many_tasks(profiles.sparkSession), "lead", "group")
    across = dealt.mapInArrow(cutter(len(order), list(back), link), "mask long, c long")
    size = F.expr("na * (n - na)") if link else pairs_of("n")
    there = sum((F.when(F.col(f).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, f in enumerate(order)), F.lit(0).cast("long"))
    inside = profiles.select(there.alias("there"), size.alias("c")).where("c > 0").groupBy("there").agg(F.sum("c").alias("c"))
    inside = inside.repartition(many_tasks(profiles.sparkSession)).select("there", "c", F.explode(F.split(F.lit(",".join(map(str, back))), ",").cast("array<long>")).alias("mask")).where(
        F.col("mask").bitwiseAND(F.col("there")) == F.col("mask")).select("mask", "c")
    local = F.lit(0).cast("long")
    for k, f in enumerate(order):
        local = local.bitwiseOR(F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.lit(1 << place[f])).otherwise(F.lit(0)).cast("long"))
    return across.unionByName(inside).groupBy("mask").agg(F.sum("c").alias("c")).select(local.alias("mask"), "c")


def _pairs_per_set(records, fields, sets, link):
    """Pairs that agree on all fields of each set: (mask, c), from one aggregation over all sets, or from groups cut field by field where the sets are many.

    Records are folded to distinct profiles first, and rows are folded before each shuffle, so a frequent value costs no more than a
    rare one. What records of one id and the same values would make among themselves is taken off again; ids that
    occur once add nothing, and if there are no others adaptive execution drops that branch.
    """
    used = [f for f in fields if any(f in one for one in sets)]
    bit = {f: 1 << fields.index(f) for f in used}
    local = [sum(1 << used.index(f) for f in one) for one in sets]

    def counted(rows, by=()):
        """Groups of equal values under every set; a single set is grouped by its own columns."""
        in_a = F.count_if(F.col("source_dataset") == "A").alias("na")
        profiles = rows.dropna(subset=used) if len(sets) == 1 else rows
        profiles = profiles.groupBy(*by, *used).agg(F.count("*").alias("n"), in_a)
        return profiles.select(F.lit(local[0]).cast("long").alias("mask"), "n", "na") if len(sets) == 1 else _masked(profiles, used, local, by)

    if len(sets) > MANY_SETS:
        spread = records.agg(*[F.approx_count_distinct(f).alias(f) for f in used]).first()
        order = sorted(used, key=lambda f: -spread[f])

    def pairs_within(rows, by=()):
        if len(sets) > MANY_SETS:
            in_a = F.count_if(F.col("source_dataset") == "A").alias("na")
            return _cut_pairs(rows.groupBy(*by, *used).agg(F.count("*").alias("n"), in_a), used, order, local, link, by)
        size = F.expr("na * (n - na)") if link else pairs_of("n")
        # Groups of one record make no pair.
        return counted(rows, by).where("n > 1").select("mask", size.alias("c"))

    pairs = pairs_within(records)
    if not link:
        # Same identity on both sides: pairs inside an id, by the same sets.
        ids = ["source_dataset", "unique_id"]
        repeated = records.groupBy(*ids).agg(F.count("*").alias("_copies")).where("_copies > 1").drop("_copies")
        twice = records.select(*ids, *used).join(repeated, ids, "left_semi")
        pairs = pairs.unionByName(pairs_within(twice.withColumnsRenamed({"unique_id": "_uid", "source_dataset": "_sid"}).withColumn(
            "source_dataset", F.col("_sid")), ["_sid", "_uid"]).select("mask", (-F.col("c")).alias("c")))
    out = pairs.groupBy("mask").agg(F.sum("c").alias("c"))
    if used == list(fields):
        return out
    parts = F.lit(0).cast("long")
    for i, f in enumerate(used):
        parts = parts.bitwiseOR(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(bit[f])).otherwise(F.lit(0)).cast("long"))
    return out.select(parts.alias("mask"), "c")


def agreement_patterns(records, fields, link=False):
    """How many record pairs agree on exactly which of the fields, for every pattern that occurs.

    Pairs agreeing on at least a set of fields are counted from group sizes, for all sets in one aggregation over the distinct
    profiles; then inclusion and exclusion over supersets (a Moebius transform) leaves the exact counts. No pair is made, so a value
    shared by a third of all records costs the same as any other. Gives covers_<f> flags and n_pairs; pairs agreeing on
    nothing are left out.
    """
    sets = [list(c) for k in range(1, len(fields) + 1) for c in combinations(fields, k)]
    at_least = _pairs_per_set(records, fields, sets, link).where("c <> 0")
    # All subsets of a mask, by dropping its bits one after the other: 3 ** fields rows in all at most.
    subsets = F.aggregate(F.array(*[F.lit(1 << i).cast("long") for i in range(len(fields))]), F.array("mask"), lambda known, b: F.when(
        F.col("mask").bitwiseAND(b) != 0, F.concat(known, F.transform(known, lambda m: m.bitwiseXOR(b)))).otherwise(known))
    sign = F.when(F.bit_count(F.col("mask").bitwiseXOR(F.col("sub"))) % 2 == 0, F.col("c")).otherwise(-F.col("c"))
    exact = (at_least.select("mask", "c", F.explode(subsets).alias("sub")).where("sub <> 0")
             .groupBy("sub").agg(F.sum(sign).alias("n_pairs")).where("n_pairs > 0"))
    flags = [(F.col("sub").bitwiseAND(F.lit(1 << i)) != 0).alias(f"covers_{f}") for i, f in enumerate(fields)]
    return exact.select(*flags, "n_pairs")


def pattern_covers(rule):
    out = F.lit(True)
    for f in rule:
        out = out & F.col(f"covers_{f}")
    return out


def first_rule(rules, labels=None):
    """Index (or label) of the first rule that covers an agreement pattern; null when none does."""
    out = None
    for i, rule in enumerate(rules):
        value = F.lit(labels[i] if labels else i)
        out = F.when(pattern_covers(rule), value) if out is None else out.when(pattern_covers(rule), value)
    return out


def field_counts(a, fields, b=None):
    """(field, n_pairs) of every single-field rule, in one aggregation."""
    both = both_tables(a, b)
    counts = _pairs_per_set(both, fields, [[f] for f in fields], b is not None)
    names = both.sparkSession.createDataFrame([(1 << i, f) for i, f in enumerate(fields)], "mask long, field string")
    return F.broadcast(names).join(counts, "mask", "left").select("field", F.coalesce("c", F.lit(0)).alias("n_pairs"))


def rule_increments(a, rules, b=None):
    """(rule_index, n): pairs each rule adds beyond the rules before it, by inclusion and exclusion.

    A pair new with rule i agrees on its fields and on those of no earlier rule. Unions of fields that come about in several
    ways are counted once, with their signs added up, and rules implied by an earlier one add nothing; so the number of counts is
    bounded by the combinations of fields, not of rules. No pair is made. A rule with a further test is counted from
    its pairs, for group sizes cannot tell.
    """
    if any(residual(r) for r in rules):
        return candidate_pairs(a, rules, [], b).groupBy(F.col("match_key").alias("rule_index")).agg(F.count("*").alias("n"))
    both = both_tables(a, b)
    fields = list(dict.fromkeys(f for rule in rules for f in rule))
    bit = {f: 1 << i for i, f in enumerate(fields)}
    masks = [sum({bit[f] for f in rule}) for rule in rules]
    signed = []
    for i, mask in enumerate(masks):
        earlier = {m | mask for m in masks[:i]}
        if mask in earlier:
            continue
        least = [m for m in earlier if not any(o != m and o & m == o for o in earlier)]
        terms = {mask: 1}
        for other in least:
            for known, sign in list(terms.items()):
                terms[known | other] = terms.get(known | other, 0) - sign
        signed += [(m, i, sign) for m, sign in terms.items() if sign]
    sets = [[f for f in fields if bit[f] & mask] for mask in sorted({m for m, _, _ in signed})]
    counts = _pairs_per_set(both, fields, sets, b is not None)
    signs = both.sparkSession.createDataFrame(signed, "mask long, rule_index int, sign int")
    return counts.join(F.broadcast(signs), "mask").groupBy("rule_index").agg(F.sum(F.col("c") * F.col("sign")).alias("n"))


#: Rules from which on it pays to look for rules that the records make superfluous: sets of fields double with every rule.
MANY_RULES = 7


def determined(records, fields):
    """{field: the fields that it determines}: records that share a value of the field, not null, share one of each of those, not null either."""
    rows, parts = records.select(*fields).distinct(), None
    for f in fields:
        others = [o for o in fields if o != f]
        groups = rows.where(F.col(f).isNotNull()).select(f, *[F.xxhash64(o).alias(f"_h_{o}") for o in others], *[F.col(o).isNull().alias(f"_no_{o}") for o in others]).groupBy(f).agg(
            *[((F.min(f"_h_{o}") == F.max(f"_h_{o}")) & (F.count_if(F.col(f"_no_{o}")) == 0)).alias(f"_{o}") for o in others])
        found = groups.agg(*[F.coalesce(F.every(f"_{o}"), F.lit(False)).alias(f"_{o}") for o in others]).select(
            F.lit(f).alias("field"), F.array_compact(F.array(*[F.when(F.col(f"_{o}"), F.lit(o)) for o in others])).alias("others"))
        parts = found if parts is None else parts.unionByName(found)
    return {row["field"]: set(row["others"]) for row in parts.collect()}     # one row per field


def needed_rules(records, rules):
    """The rules without those whose pairs all satisfy another one, by what the fields determine in these records: the union of their pairs is the same."""
    known = determined(records, list(dict.fromkeys(f for rule in rules for f in rule)))
    kept = list(rules)
    for rule in rules:
        reach = set(rule).union(*(known[f] for f in rule))
        rest = [other for other in kept if other is not rule]
        if any(set(other) <= reach for other in rest):
            kept = rest
    return kept


def candidate_count(a, rules, b=None):
    """Exact size of the candidate set for a rule list, without making pairs. Of many rules, those that the records make superfluous are left out."""
    both = both_tables(a, b)
    rules = [rule if residual(rule) else [f for f in rule if f in a.columns] for rule in rules]
    rules = [rule for rule in rules if rule or residual(rule)]
    if not rules:
        return a.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_pairs"))
    if len(rules) >= MANY_RULES and not any(residual(r) for r in rules):
        rules = needed_rules(both, rules)
    if len(rules) == 1 and not residual(rules[0]):
        return block_counts(both, rules[0], link=b is not None)
    return rule_increments(a, rules, b).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))


def rule_counts(a, rules, b=None):
    """Pairs that each rule adds beyond the rules before it, with the rule text."""
    return named_rules(rule_increments(a, rules, b).where("n > 0"), rules)


def named_rules(counts, rules):
    """Attach the rule text; an index outside the list is shown as 'Rule i'."""
    spark = counts.sparkSession
    names = spark.createDataFrame([(i, rule_sql(r)) for i, r in enumerate(rules)], "rule_index int, rule_sql string")
    return counts.join(F.broadcast(names), "rule_index", "left").select(
        F.col("rule_index").cast("int").alias("rule_index"),
        F.coalesce("rule_sql", F.concat(F.lit("Rule "), F.col("rule_index"))).alias("rule_sql"),
        F.col("n").cast("long").alias("n"))


def cumulative(counts):
    """Running total by rule; one row per rule, so the single window partition stays tiny."""
    order = Window.orderBy("rule_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select("rule_index", "rule_sql", "n", F.sum("n").over(order).alias("cumulative_n"))


def estimate_per_rule(a, rules, b=None, warning=500_000, danger=5_000_000):
    """Uniform-block estimate of each rule with a verdict, next to the largest real block."""
    other = a if b is None else b
    parts = []
    for i, rule in enumerate(rules):
        sizes = a.dropna(subset=rule).groupBy(*rule).count()
        stats = sizes.agg(F.count("*").alias("n_unique"), F.max("count").alias("largest_block"))
        rows_a = a.agg(F.count("*").alias("n_a"))
        rows_b = other.agg(F.count("*").alias("n_b"))
        one = lambda df: df.withColumn("_one", F.lit(1))
        joined = one(stats).join(F.broadcast(one(rows_a)), "_one").join(F.broadcast(one(rows_b)), "_one")
        estimate = F.when(F.col("n_unique") > 0, F.expr("(n_a * n_b) div n_unique")).otherwise(F.lit(0))
        parts.append(joined.select(
            F.lit(i).alias("rule_index"), F.lit("+".join(rule)).alias("rule"), "n_unique",
            F.coalesce("largest_block", F.lit(0)).alias("largest_block"), estimate.cast("long").alias("estimate")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    verdict = F.when(F.col("estimate") > danger, "danger").when(F.col("estimate") > warning, "warning").otherwise("ok")
    return out.withColumn("verdict", verdict)


def truth_pairs(records, link=False, hot_block=HOT_BLOCK):
    """Ground-truth pairs: records of one cluster, ordered; across sources only in link mode."""
    pairs = paired(records, None, [["cluster"]], ["cluster"], hot_block)
    if link:
        pairs = pairs.where("source_dataset_l <> source_dataset_r")
    return pairs.select("unique_id_l", "source_dataset_l", "unique_id_r", "source_dataset_r",
                        F.lit(1.0).alias("clerical_match_score"))


def truth_pair_count(records, link=False):
    """Number of ground-truth pairs from cluster sizes per source; no pairs are made. Records of one id are no pair."""
    per_id = records.dropna(subset=["cluster"]).groupBy("cluster", "source_dataset", "unique_id").agg(F.count("*").alias("k"))
    sized = per_id.groupBy("cluster", "source_dataset").agg(F.sum("k").alias("n"), F.sum(pairs_of("k")).alias("same"))
    total = sized.groupBy("cluster").agg(F.sum("n").alias("t"), F.sum(pairs_of("n")).alias("inside"), F.sum("same").alias("same"))
    pairs = pairs_of("t") - F.col("inside") if link else pairs_of("t") - F.col("same")
    return total.agg(F.coalesce(F.sum(pairs), F.lit(0)).cast("long").alias("n_gt_edges"))
