"""Estimating the model: prior, u-probabilities and EM for the m-probabilities."""
import copy
import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinsift.fixed_values import (EM_CONVERGENCE, MAX_ITERATIONS, RECALL, TRAINING_HINTS, U_SAMPLE_PAIRS)
from kinsift.functions.draws import SPAN, draw
from kinsift.functions.numbers import pairs_of, ratio
from kinsift.operators.blocking import block_counts, both_tables, common_types, field_counts, paired
from kinsift.operators.comparators import gamma_of_places, level_gammas, of_few_values, with_gammas, with_places
from kinsift.operators.value_join import counted_levels, level_pairs
from kinsift.session import materialise

FLOOR = 1e-10
U_SAMPLE_RECORDS = 4000


def rank_training_fields(fields, toggles=None):
    """Fields to block on while training: hinted names in their fixed order, then the others by name; only fields with a
    rule of their own switched on, if there are any."""
    on = {f for f, wanted in (toggles or {}).items() if wanted}.intersection(fields)
    hinted = [f for f in TRAINING_HINTS if f in fields]
    return [f for f in hinted + sorted(set(fields).difference(hinted)) if f in on or not on]


def estimate_prior(a, rule, recall=RECALL, b=None):
    """Probability that two random records match: pairs agreeing on the rule / recall / all pairs."""
    both = both_tables(a, b)
    found = block_counts(both, rule, link=b is not None).withColumn("_one", F.lit(1))
    total = both.agg(F.count("*").alias("n"), F.count_if(F.col("source_dataset") == "A").alias("na"))
    every = F.expr("na * (n - na)") if b is not None else pairs_of("n")
    total = total.select(every.alias("all_pairs"), F.lit(1).alias("_one"))
    prior = ratio(F.col("n_pairs") / F.lit(float(recall)), F.col("all_pairs"))
    return (found.join(F.broadcast(total), "_one")
            .select("n_pairs", "all_pairs", F.least(prior, F.lit(1.0)).alias("prior")))


def random_pairs(a, fields, b=None, n_records=None, target=U_SAMPLE_PAIRS, seed=42, sample=U_SAMPLE_RECORDS):
    """About `target` random record pairs: a hash sample of records, each paired with the next ones
    in hash order. The sample has a fixed size, so its ranking fits one task at any table size."""
    reach = max(target // sample, 1)

    def ranked(records, total, suffix):
        rate = min(1.0, sample / max(total, 1))
        key = draw("u", F.col("unique_id"), 0, seed)
        chosen = records.where(key < F.lit(int(rate * SPAN))) if rate < 1.0 else records
        order = Window.orderBy(key, F.col("unique_id"))
        chosen = chosen.select("*", (F.row_number().over(order) - 1).alias("_rank"),
                               F.count("*").over(Window.partitionBy()).alias("_size"))
        return chosen.select(*[F.col(f).alias(f"{f}_{suffix}") for f in fields],
                             F.col("_rank").alias(f"_rank_{suffix}"), F.col("_size").alias(f"_size_{suffix}"))

    left = ranked(a, n_records or a.count(), "l")
    if b is None:
        right = left.select(*[F.col(f"{f}_l").alias(f"{f}_r") for f in fields], F.col("_rank_l").alias("_rank_r"))
        limit = F.least(F.lit(reach), ((F.col("_size_l") - 1) / 2).cast("int"))
        left = left.where(limit >= 1).withColumn("_step", F.explode(F.sequence(F.lit(1), limit)))
        left = left.withColumn("_want", (F.col("_rank_l") + F.col("_step")) % F.col("_size_l"))
    else:
        right = ranked(b, b.count(), "r")
        size = right.agg(F.max("_size_r").alias("_span")).withColumn("_one", F.lit(1))
        left = left.withColumn("_one", F.lit(1)).join(F.broadcast(size), "_one")
        left = left.withColumn("_step", F.explode(F.sequence(F.lit(1), F.least(F.lit(reach), F.col("_span")))))
        left = left.withColumn("_want", (F.col("_rank_l") + F.col("_step")) % F.col("_span"))
    joined = left.join(right, left["_want"] == right["_rank_r"])
    return joined.select(*[f"{f}_{s}" for f in fields for s in "lr"])


def estimate_u(a, comparisons, b=None, n_records=None, target=U_SAMPLE_PAIRS, seed=42, sample=U_SAMPLE_RECORDS):
    """Share of each level among random pairs where both values are present: (field, gamma, n, u_prob)."""
    fields = [c["output_column_name"] for c in comparisons]
    scored = with_gammas(random_pairs(a, fields, b, n_records, target, seed, sample), comparisons)
    return level_shares(scored, fields)


def estimate_u_exact(a, fields, b=None):
    """u of plain equality, from all records: (field, n_agree, n_both, u_prob). n_agree is the number of pairs with equal
    values, n_both that of pairs with both values, each from group sizes; no pair is made and nothing is sampled."""
    both = both_tables(a, b)
    present = both.agg(*[F.count(f).alias(f"n_{f}") for f in fields],
                       *[F.count_if((F.col("source_dataset") == "A") & F.col(f).isNotNull()).alias(f"a_{f}") for f in fields])
    size = (lambda f: F.col(f"a_{f}") * (F.col(f"n_{f}") - F.col(f"a_{f}"))) if b is not None else (lambda f: pairs_of(f"n_{f}"))
    known = present.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), size(f).cast("long").alias("n_both")) for f in fields])).alias("x")).select("x.*")
    return (field_counts(a, fields, b).withColumnRenamed("n_pairs", "n_agree").join(F.broadcast(known), "field")
            .select("field", "n_agree", "n_both", ratio(F.col("n_agree"), F.col("n_both")).alias("u_prob")))


def estimate_u_fuzzy(a, comparisons, b=None):
    """u of the fuzzy levels that few pairs reach, from all records: (field, gamma, n_pairs, n_both, u_prob). Values that are alike are found by
    a similarity join over the distinct values and weighted by how often they occur, so nothing is sampled and no pair of records
    is made. Levels that many pairs reach are not in the result."""
    both = both_tables(a, b)
    known = [c for c in comparisons if counted_levels(c)]
    if not known:
        return both.sparkSession.createDataFrame([], "field string, gamma int, n_pairs long, n_both long, u_prob double")
    present = estimate_u_exact(a, [c["output_column_name"] for c in known], b).select("field", "n_both")
    counts, shown = None, []
    for c in known:
        one = level_pairs(both, c, b is not None)
        counts = one if counts is None else counts.unionByName(one)
        shown += [(c["output_column_name"], g) for g, _, _ in counted_levels(c)]
    levels = both.sparkSession.createDataFrame(shown, "field string, gamma int")
    return (F.broadcast(levels).join(counts, ["field", "gamma"], "left").join(F.broadcast(present), "field")
            .select("field", "gamma", F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"), "n_both")
            .withColumn("u_prob", ratio(F.col("n_pairs"), F.col("n_both"))))


def _tests_equality(comparison):
    """Whether the highest level is plain equality of the column."""
    field = comparison["output_column_name"]
    first = next(level for level in comparison["comparison_levels"] if not level.get("is_null_level"))
    return first["sql_condition"].replace(" ", "") == f'"{field}_l"="{field}_r"'


def u_of_levels(a, comparisons, b=None, target=U_SAMPLE_PAIRS, seed=42, sample=U_SAMPLE_RECORDS):
    """{field: {gamma: (u, observed)}}. Equality and the fuzzy levels that few pairs reach are counted over all records; the other levels share
    what is left as they do among sampled pairs that reach none of those. A level that no pair shows is given less than
    one pair's share and marked as not observed."""
    fields = [c["output_column_name"] for c in comparisons]
    exact = {r["field"]: (r["u_prob"], r["n_both"]) for r in estimate_u_exact(a, fields, b).collect()}     # one row per field
    fuzzy = {(r["field"], r["gamma"]): r["u_prob"] for r in estimate_u_fuzzy(a, comparisons, b).collect()}     # one row per level
    counts = {}
    for row in estimate_u(a, comparisons, b, target=target, seed=seed, sample=sample).collect():     # one row per level of the model
        counts.setdefault(row["field"], {})[row["gamma"]] = row["n"]
    out = {}
    for c in comparisons:
        f, seen = c["output_column_name"], counts.get(c["output_column_name"], {})
        levels = [g for g in level_gammas(c) if g >= 0]
        known = {g: fuzzy[f, g] for g in levels if fuzzy.get((f, g)) is not None}
        if _tests_equality(c) and exact.get(f, (None, 0))[0] is not None:
            known[max(levels)] = exact[f][0]
        sampled = [g for g in levels if g not in known]
        total = sum(seen.get(g, 0) for g in sampled)
        rest = max(1.0 - sum(known.values()), 0.0)
        shares = {g: rest * seen[g] / total for g in sampled if seen.get(g)}
        out[f] = {g: (shares[g], True) if g in shares else (rest / (total + 1) / 2, False) for g in sampled}
        pairs = exact.get(f, (None, 0))[1] or 1
        out[f].update({g: (u, True) if u else (0.5 / pairs, False) for g, u in known.items()})
    return out


def level_shares(scored, fields, weight=None):
    n = F.lit(1) if weight is None else F.col(weight)
    long = scored.select(n.alias("_n"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"gamma_{f}").alias("gamma")) for f in fields])).alias("x"))
    counts = (long.select("x.field", "x.gamma", "_n").where("gamma >= 0")
              .groupBy("field", "gamma").agg(F.sum("_n").alias("n")))
    whole = F.sum("n").over(Window.partitionBy("field"))
    return counts.select("field", "gamma", "n", (F.col("n") / whole).alias("u_prob"))


def pattern_counts(a, rule, comparisons, b=None):
    """Pairs of one training block counted by gamma pattern.

    Records with the same values are first folded into one profile with a count; profiles are
    paired and weighted, and pairs inside a profile come from its count alone. A group of copies
    therefore costs one row, however large it is. Gammas of a field with few values are looked up.
    """
    fields = [c["output_column_name"] for c in comparisons]
    columns = list(dict.fromkeys(list(rule) + fields))

    def profiles(records):
        return records.dropna(subset=rule).groupBy(*columns).agg(
            F.min("unique_id").alias("unique_id"), F.min("source_dataset").alias("source_dataset"),
            F.count("*").alias("_copies"))

    if b is not None:
        a, b = common_types(a, b)
    few = of_few_values([a] if b is None else [a, b], comparisons)
    left = with_places(profiles(a), few)
    read = [f"_place_{f}" if f in few else f for f in fields]
    pairs = paired(left, None if b is None else with_places(profiles(b), few), [list(rule)], list(dict.fromkeys([*rule, *read])) + ["_copies"])
    weighted = pairs.select(*[f"{f}_{s}" for f in read for s in "lr"], (F.col("_copies_l") * F.col("_copies_r")).alias("_w"))
    if b is None:
        inside = left.where("_copies > 1").select(*[F.col(f).alias(f"{f}_{s}") for f in read for s in "lr"],
                                            pairs_of("_copies").alias("_w"))
        weighted = weighted.unionByName(inside)
    scored = with_gammas(weighted.select("*", *[gamma_of_places(f, few) for f in few]), [c for c in comparisons if c["output_column_name"] not in few])
    return scored.groupBy(*[f"gamma_{f}" for f in fields]).agg(F.sum("_w").alias("n"))


def starting_m(comparison):
    """0.9 on the highest level, the rest shared equally."""
    gammas = [g for g in level_gammas(comparison) if g >= 0]
    rest = 0.1 / max(len(gammas) - 1, 1)
    return {g: (0.9 if g == max(gammas) else rest) for g in gammas}


def _likelihood(params, fields):
    """Product over fields of the level's probability. The probabilities are array literals, so all rounds run the same
    generated code."""
    total = F.lit(1.0)
    for f in fields:
        table = F.array(*[F.lit(max(float(params[f].get(g, 1.0)), FLOOR)) for g in range(max(params[f]) + 1)])
        total = total * F.when(F.col(f"gamma_{f}") >= 0, F.coalesce(F.get(table, F.col(f"gamma_{f}")), F.lit(1.0))).otherwise(F.lit(1.0))
    return total


def em_step(patterns, m, u, prior):
    """One E and M step as a single aggregation: new prior and, per field and level, new m."""
    fields = list(m)
    match = _likelihood(m, fields) * F.lit(float(prior))
    other = _likelihood(u, fields) * F.lit(1.0 - float(prior))
    scored = patterns.withColumn("_p", match / (match + other))
    expected = F.col("n") * F.col("_p")
    sums = [F.sum(expected).alias("_match"), F.sum("n").alias("_all")]
    for f in fields:
        sums.append(F.sum(F.when(F.col(f"gamma_{f}") >= 0, expected)).alias(f"_seen_{f}"))
        for g in m[f]:
            sums.append(F.sum(F.when(F.col(f"gamma_{f}") == g, expected)).alias(f"_hit_{f}_{g}"))
    row = scored.agg(*sums)
    out = [ratio(F.col("_match"), F.col("_all")).alias("prior")]
    for f in fields:
        for g in m[f]:
            out.append(ratio(F.col(f"_hit_{f}_{g}"), F.col(f"_seen_{f}")).alias(f"m_{f}_{g}"))
    return row.select(*out)


def em_rows(step, m):
    """The result of a step as (field, gamma, m_prob) rows."""
    cells = [F.struct(F.lit(f).alias("field"), F.lit(g).alias("gamma"), F.col(f"m_{f}_{g}").alias("m_prob"))
             for f in m for g in m[f]]
    return step.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


#: Rows up to which a pattern table is trained as arrays on the driver; the model bounds them to the product of its level counts.
LOCAL_PATTERNS = 100_000


def _local_step(counts, gammas, m, u, prior):
    """The E and M step of `em_step` over arrays of counts and gammas."""
    match, other = np.full(len(counts), prior), np.full(len(counts), 1.0 - prior)
    for f, g in gammas.items():
        for level in m[f]:
            at = g == level
            match[at] *= max(m[f][level], FLOOR)
            other[at] *= max(u[f].get(level, 1.0), FLOOR)
    expected = counts * (match / (match + other))
    out = {"prior": expected.sum() / counts.sum() if counts.sum() else None}
    for f, g in gammas.items():
        seen = expected[g >= 0].sum()
        for level in m[f]:
            at = g == level
            out[f"m_{f}_{level}"] = expected[at].sum() / seen if seen and at.any() else None
    return out


def em_train(patterns, m, u, prior, max_iterations=MAX_ITERATIONS, convergence=EM_CONVERGENCE):
    """Iterate over the pattern table, which the model bounds to the product of its level counts. Where that is at most LOCAL_PATTERNS, one
    job brings the table over and the rounds run on arrays; a larger one stays in Spark, one aggregation a round. A level that
    no pair shows keeps its starting value."""
    fields = list(m)
    bound = math.prod(len(m[f]) + 1 for f in fields)
    if bound <= LOCAL_PATTERNS:
        # Values of gamma beyond the model's levels would break the bound; there are none.
        table = patterns.select("n", *[f"gamma_{f}" for f in fields]).limit(bound + 1).toPandas().sort_values([f"gamma_{f}" for f in fields])
        counts, gammas = table["n"].to_numpy(float), {f: table[f"gamma_{f}"].to_numpy() for f in fields}
        step = lambda m, prior: _local_step(counts, gammas, m, u, prior)
    else:
        patterns = materialise(patterns)
        step = lambda m, prior: em_step(patterns, m, u, prior).first()
    m, unseen = copy.deepcopy(m), set()
    for _ in range(max_iterations):
        row = step(m, prior)
        change = 0.0
        for f in fields:
            for g in m[f]:
                value = row[f"m_{f}_{g}"]
                if value is None:
                    unseen.add((f, g))
                    continue
                value = max(float(value), FLOOR)
                change = max(change, abs(value - m[f][g]))
                m[f][g] = value
        prior = min(max(row["prior"] or FLOOR, FLOOR), 1.0 - FLOOR)
        if change < convergence:
            break
    return m, prior, unseen


def merge_sessions(sessions):
    """One m per level: the mean of the sessions that estimated it."""
    out = {}
    for m in sessions:
        for f, levels in m.items():
            for g, value in levels.items():
                out.setdefault(f, {}).setdefault(g, []).append(value)
    return {f: {g: sum(v) / len(v) for g, v in levels.items()} for f, levels in out.items()}


def train(a, comparisons, toggles=None, b=None, hyperparams=None, seed=42):
    """Prior, u and m for the comparisons. Returns (prior, comparisons with m and u filled in)."""
    hp = hyperparams or {}
    fields = [c["output_column_name"] for c in comparisons]
    candidates = rank_training_fields(fields, toggles)
    found = {r["field"]: r["n_pairs"] for r in field_counts(a, candidates, b).collect()}     # one row per field
    usable = [f for f in candidates if found[f] > 0]
    if not usable:
        raise ValueError("Could not train: none of the fields " + ", ".join(candidates) + " is shared by two records.")
    prior = estimate_prior(a, [usable[0]], hp.get("recall_estimate", RECALL), b).first()["prior"]
    levels = u_of_levels(a, comparisons, b, hp.get("u_sample_pairs", U_SAMPLE_PAIRS), seed, hp.get("u_sample_records", U_SAMPLE_RECORDS))
    u = {f: {g: max(value, FLOOR) for g, (value, _) in known.items()} for f, known in levels.items()}
    sessions = []
    for held_out in usable[:2]:
        trained = [c for c in comparisons if c["output_column_name"] != held_out]
        if not trained:
            continue
        patterns = pattern_counts(a, [held_out], trained, b)
        start = {c["output_column_name"]: starting_m(c) for c in trained}
        m, _, _ = em_train(patterns, start, u, prior, hp.get("max_iterations", MAX_ITERATIONS),
                           hp.get("em_convergence", EM_CONVERGENCE))
        sessions.append(m)
    merged = merge_sessions(sessions)
    filled = copy.deepcopy(comparisons)
    for c in filled:
        f = c["output_column_name"]
        start = starting_m(c)
        for level, g in zip(c["comparison_levels"], level_gammas(c)):
            if g >= 0:
                level["m_probability"] = merged.get(f, start).get(g, start[g])
                level["u_probability"] = u[f][g]
                level["u_observed"] = levels[f][g][1]
    return prior, filled
