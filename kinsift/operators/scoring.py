"""Fellegi-Sunter scoring and the flat view of a model."""
import math

from pyspark.sql import functions as F

from kinsift.fixed_values import PRIOR_FALLBACK, WEIGHT_THRESHOLD
from kinsift.operators.blocking import HOT_BLOCK, candidate_pairs, common_types, join_keys, unfold
from kinsift.operators.comparators import SIMILARITY_CALL, by_side, level_gammas, with_gammas


def prior_log_odds(prior):
    return math.log2(prior / (1.0 - prior)) if prior and 0 < prior < 1 else PRIOR_FALLBACK


def level_weight(level):
    """log2(m/u); none for the null level or where m or u is missing or zero."""
    m, u = level.get("m_probability"), level.get("u_probability")
    return None if level.get("is_null_level") or not m or not u else math.log2(m / u)


def gamma_weight(comparison):
    """SQL of the weight of one comparison's level, looked up by gamma."""
    weights = dict(zip(level_gammas(comparison), (level_weight(level) or 0.0 for level in comparison["comparison_levels"])))
    table = ", ".join(f"{weights.get(g, 0.0)!r}D" for g in range(-1, max(weights) + 1))
    return f"coalesce(try_element_at(array({table}), `gamma_{comparison['output_column_name']}` + 2), 0.0D)"


def match_weight(model):
    """Prior plus the weight of each comparison's level."""
    start = repr(prior_log_odds(model["probability_two_random_records_match"])) + "D"
    return F.expr(" + ".join([start, *[gamma_weight(c) for c in model["comparisons"]]]))


def probability(weight):
    """2^w / (1 + 2^w), with w held inside what a double can carry."""
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(2.0), F.greatest(F.least(-weight, F.lit(1000.0)), F.lit(-1000.0))))


def best_weights(comparison):
    """(best weight given exact equality, best weight without it) of one comparison.

    Only a first level that tests plain equality tells the two cases apart.
    """
    field = comparison["output_column_name"]
    levels = comparison["comparison_levels"]
    weights = [level_weight(level) or 0.0 for level in levels]
    first = [bool(level.get("is_null_level")) for level in levels].index(False)
    if levels[first]["sql_condition"].replace(" ", "") != f'"{field}_l"="{field}_r"':
        return max(weights + [0.0]), max(weights + [0.0])
    others = [w for i, w in enumerate(weights) if i != first]
    return max(weights[first], 0.0), max(others + [0.0])


#: Sharper keys that may stand for one rule. Each is one more copy of every record, so a rule that would need more stays as
#: it is, and hopeless pairs are dropped after the join instead.
KEYS_PER_RULE = 3


def reachable_rules(model, rules, threshold):
    """Join keys that cover every pair able to reach the threshold.

    A pair found by a rule but exact on nothing else has a largest possible weight. Where that stays
    below the threshold, further exact agreement is needed, and it moves into the join key: blocks
    get smaller and no pair that could pass is lost. A rule that no agreement can save is left out.
    """
    table = {c["output_column_name"]: best_weights(c) for c in model["comparisons"]}
    start = prior_log_odds(model["probability_two_random_records_match"])
    slack = 1e-9

    def ceiling(exact):
        return start + sum((e if f in exact else b) for f, (e, b) in table.items())

    out = []
    for rule in join_keys(rules):
        spare = [f for f in table if f not in rule]
        if ceiling(set(rule) | set(spare)) < threshold - slack:
            continue
        fits = []
        frontier = [tuple()]
        while frontier and len(fits) <= KEYS_PER_RULE:
            nxt = []
            for extra in frontier:
                if len(fits) > KEYS_PER_RULE:
                    break
                if any(set(done) <= set(extra) for done in fits):
                    continue
                if ceiling(set(rule) | set(extra)) >= threshold - slack:
                    fits.append(extra)
                else:
                    tail = spare.index(extra[-1]) + 1 if extra else 0
                    nxt += [extra + (f,) for f in spare[tail:]]
            frontier = nxt if len(nxt) <= 1000 else []
            fits = fits if frontier or not nxt else [()] * (KEYS_PER_RULE + 1)
        out += [list(rule) + list(extra) for extra in (fits if len(fits) <= KEYS_PER_RULE else [()])]
    kept = []
    for rule in out:
        if not any(set(other) <= set(rule) for other in kept):
            kept = [other for other in kept if not set(rule) <= set(other)] + [rule]
    return kept


def hopeful(pairs, model, threshold, known=()):
    """Drop pairs that stay under the threshold whatever their similarities turn out to be: a test on plain equality, and on the gammas of the
    `known` fields, that spares them the other comparisons."""
    total = repr(prior_log_odds(model["probability_two_random_records_match"]))
    for c in model["comparisons"]:
        f, (exact, other) = c["output_column_name"], best_weights(c)
        total += " + " + (gamma_weight(c) if f in known else f"CASE WHEN `{f}_l` = `{f}_r` THEN {exact!r}D ELSE {other!r}D END")
    return pairs.where(F.expr(f"{total} >= {float(threshold) - 1e-9!r}"))


def by_cost(comparisons):
    """Groups of comparisons, cheap ones first: all that Spark's own functions answer, then one group for each with string similarities. Of these, the ones
    with fewer similarities come first, and then those whose levels differ most in weight."""
    calls = lambda c: {call for level in c["comparison_levels"] for call in SIMILARITY_CALL.findall(level["sql_condition"])}
    weights = lambda c: [level_weight(level) or 0.0 for level in c["comparison_levels"]]
    plain = [c for c in comparisons if not calls(c)]
    costly = sorted((c for c in comparisons if calls(c)), key=lambda c: (len(calls(c)), min(weights(c)) - max(weights(c))))
    return ([plain] if plain else []) + [[c] for c in costly]


def score(pairs, model, threshold=WEIGHT_THRESHOLD, comparisons=None):
    """Gammas, weight and probability of each pair; pairs under the weight threshold are dropped. Comparisons are made cheap ones first, and a pair
    goes no further once the best that the rest can give leaves it under the threshold. `comparisons` are those of the model with conditions
    that read columns made beforehand (see `by_side`)."""
    columns, comparisons = pairs.columns, comparisons or model["comparisons"]
    if threshold is None:
        scored = with_gammas(pairs, comparisons)
    else:
        known, scored = [], hopeful(pairs, model, threshold)
        for group in by_cost(comparisons):
            known += [c["output_column_name"] for c in group]
            scored = hopeful(with_gammas(scored, group), model, threshold, known)
    scored = scored.select(*columns, *[f"gamma_{c['output_column_name']}" for c in comparisons]).withColumn("match_weight", match_weight(model))
    if threshold is not None:
        scored = scored.where(F.col("match_weight") >= F.lit(float(threshold)))
    return scored.withColumn("match_probability", probability(F.col("match_weight")))


def predict(a, rules, model, b=None, threshold=WEIGHT_THRESHOLD, keep=(), hot_block=HOT_BLOCK):
    """Candidates of the rules, scored. Exact pruning keeps hopeless pairs from being made."""
    return unfold(predict_folded(a, rules, model, b, threshold, keep, hot_block))


def predict_folded(a, rules, model, b=None, threshold=WEIGHT_THRESHOLD, keep=(), hot_block=HOT_BLOCK):
    """The scored pairs, folded where many records are alike: a score depends on the values alone, so it is worked out once for all records that
    have them. `unfold` gives the record pairs."""
    fields = [c["output_column_name"] for c in model["comparisons"]]
    carried = list(dict.fromkeys(fields + list(keep)))
    joins = None
    if threshold is not None:
        joins = reachable_rules(model, rules, threshold)
    hopeless = joins == []
    if b is not None:
        a, b = common_types(a, b)
    made, comparisons = by_side(model["comparisons"])
    with_made = lambda df: df if df is None else df.withColumns({name: F.expr(expression) for name, expression in made.items()})
    pairs = candidate_pairs(with_made(a), rules, carried + list(made), with_made(b), join_rules=joins, hot_block=hot_block, folded=True)
    if hopeless:
        pairs = pairs.where(F.lit(False))
    return score(pairs, model, threshold, comparisons).drop(*[f"{name}_{s}" for name in made for s in "lr"])


# ---- the model as rows -----------------------------------------------------------------------------

LEVEL_SCHEMA = ("field string, level int, gamma int, label string, condition string, is_null boolean, "
                "m_prob double, u_prob double")


def model_params(spark, model):
    """One row per level with its weight; as many rows as the model has levels."""
    rows = []
    for comparison in model["comparisons"]:
        for i, (level, value) in enumerate(zip(comparison["comparison_levels"], level_gammas(comparison))):
            rows.append((comparison["output_column_name"], i, value, level.get("label_for_charts"), level["sql_condition"],
                         bool(level.get("is_null_level")), level.get("m_probability"), level.get("u_probability")))
    flat = spark.createDataFrame(rows, LEVEL_SCHEMA)
    usable = (~F.col("is_null")) & (F.col("m_prob") > 0) & (F.col("u_prob") > 0)
    return flat.withColumn("match_weight", F.when(usable, F.log2(F.col("m_prob") / F.col("u_prob"))))
