"""Comparators: an ordered ladder of levels per field, each a SQL condition on <f>_l and <f>_r.

The first level that holds wins. The null level has gamma -1 and no evidence; the last level is
ELSE with gamma 0 and gammas rise towards exact agreement. The same conditions are stored in a
model document, so scoring from a saved model and from a fresh run share one code path.
"""
import re

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from kinsift.fixed_values import FIELD_COMPARATOR
from kinsift.functions import similarity


def _ladder(field, steps, null_condition=None):
    left, right = f'"{field}_l"', f'"{field}_r"'
    rows = [(null_condition or f"{left} IS NULL OR {right} IS NULL", f"{field} is NULL", True)]
    rows += [(condition, label, False) for condition, label in steps]
    rows.append(("ELSE", "All other comparisons", False))
    return [{"sql_condition": c, "label_for_charts": t, "is_null_level": n,
             "m_probability": None, "u_probability": None} for c, t, n in rows]


def _sides(field):
    return f'"{field}_l"', f'"{field}_r"'


def _exact(field):
    left, right = _sides(field)
    return (f"{left} = {right}", f"Exact match on {field}")


def _similar(function, field, thresholds):
    left, right = _sides(field)
    return [(f"{function}({left}, {right}) >= {t}", f"{function} of {field} >= {t}") for t in thresholds]


def exact_match(field):
    return _ladder(field, [_exact(field)])


def name_comparison(field):
    return _ladder(field, [_exact(field)] + _similar("jaro_winkler_similarity", field, [0.92, 0.88, 0.7]))


def jaro_winkler_at_thresholds(field, thresholds=(0.9, 0.7)):
    return _ladder(field, [_exact(field)] + _similar("jaro_winkler_similarity", field, thresholds))


def jaro_at_thresholds(field, thresholds=(0.9, 0.7)):
    return _ladder(field, [_exact(field)] + _similar("jaro_similarity", field, thresholds))


def levenshtein_at_thresholds(field, thresholds=(1, 2)):
    left, right = _sides(field)
    return _ladder(field, [_exact(field)] + [
        (f"levenshtein({left}, {right}) <= {t}", f"Levenshtein distance of {field} <= {t}") for t in thresholds])


def date_of_birth_comparison(field):
    left, right = _sides(field)
    date_l, date_r = f"try_to_date({left}, 'yyyy-MM-dd')", f"try_to_date({right}, 'yyyy-MM-dd')"
    # Two adjacent characters swapped are two edits, so nearly all pairs are spared the search for the place.
    swapped = (f"length({left}) = length({right}) AND length({left}) > 1 AND levenshtein({left}, {right}) <= 2 AND "
               f"exists(sequence(1, greatest(length({left}) - 1, 1)), p -> concat(left({left}, p - 1), "
               f"substr({left}, p + 1, 1), substr({left}, p, 1), substr({left}, p + 2)) = {right})")
    steps = [_exact(field), (f"levenshtein({left}, {right}) <= 1 OR ({swapped})", f"Damerau-Levenshtein of {field} <= 1")]
    steps += [(f"abs(datediff({date_l}, {date_r})) <= {days}", f"{field} within {days} days") for days in (30, 365, 3650)]
    return _ladder(field, steps, f"{date_l} IS NULL OR {date_r} IS NULL")


def email_comparison(field):
    left, right = _sides(field)
    user_l, user_r = f"substring_index({left}, '@', 1)", f"substring_index({right}, '@', 1)"
    return _ladder(field, [
        _exact(field),
        (f"{user_l} = {user_r}", f"Exact match on user part of {field}"),
        (f"jaro_winkler_similarity({left}, {right}) >= 0.88", f"Jaro-Winkler of {field} >= 0.88"),
        (f"jaro_winkler_similarity({user_l}, {user_r}) >= 0.88", f"Jaro-Winkler of user part of {field} >= 0.88"),
    ])


def postcode_comparison(field):
    left, right = _sides(field)

    def part(pattern):
        found_l, found_r = f"regexp_extract({left}, '{pattern}', 0)", f"regexp_extract({right}, '{pattern}', 0)"
        return f"{found_l} <> '' AND {found_l} = {found_r}"

    return _ladder(field, [
        _exact(field),
        (part("^[A-Z]{1,2}[0-9][A-Z0-9]? [0-9]"), f"Same sector of {field}"),
        (part("^[A-Z]{1,2}[0-9][A-Z0-9]?"), f"Same district of {field}"),
        (part("^[A-Z]{1,2}"), f"Same area of {field}"),
    ])


REGISTRY = {
    "ExactMatch": exact_match,
    "NameComparison": name_comparison,
    "DateOfBirthComparison": date_of_birth_comparison,
    "LevenshteinAtThresholds": levenshtein_at_thresholds,
    "JaroWinklerAtThresholds": jaro_winkler_at_thresholds,
    "JaroAtThresholds": jaro_at_thresholds,
    "EmailComparison": email_comparison,
    "PostcodeComparison": postcode_comparison,
}


def register_comparator(name, builder):
    """Add a comparator: builder(field) returns a list of levels."""
    REGISTRY[name] = builder


def build_comparisons(fields, chosen=None, as_coded=False):
    """Comparison per field: the caller's choice, else the default of a known field, else exact."""
    out = []
    for field in fields:
        name = (chosen or {}).get(field) or FIELD_COMPARATOR.get(field, "ExactMatch")
        if as_coded and name == "JaroAtThresholds":
            name = "ExactMatch"
        out.append({"output_column_name": field, "comparison_levels": REGISTRY.get(name, exact_match)(field)})
    return out


def to_spark_sql(condition):
    """Conditions quote columns with double quotes and may use strptime; Spark wants backticks."""
    text = re.sub(r'"([^"]+)"', r"`\1`", condition)
    text = re.sub(r"try_strptime\(([^,]+),\s*'%Y-%m-%d'\)", r"try_to_date(\1, 'yyyy-MM-dd')", text)
    return re.sub(r"\bepoch\(", "unix_timestamp(", text, flags=re.IGNORECASE)


# A call of one of the Arrow similarities, with at most one nested call per argument.
SIMILARITY_CALL = re.compile(r"(?:jaro_winkler_similarity|jaro_similarity|damerau_levenshtein)\((?:[^()]|\([^()]*\))*\)")


def gamma(comparison, known=None):
    """The gamma column of one comparison; `known` maps similarity calls to columns that hold them."""
    levels = comparison["comparison_levels"]
    rank = sum(1 for level in levels if not level.get("is_null_level"))
    steps, last = "", "NULL"
    for level in levels:
        if not level.get("is_null_level"):
            rank -= 1
        value = -1 if level.get("is_null_level") else rank
        if level["sql_condition"].strip().upper() == "ELSE":
            last = value
            break
        test = SIMILARITY_CALL.sub(lambda call: (known or {}).get(call.group(0), call.group(0)), to_spark_sql(level["sql_condition"]))
        steps += f" WHEN {test} THEN {value}"
    column = F.expr(f"CASE{steps} ELSE {last} END") if steps else F.lit(last)
    return column.cast("int").alias(f"gamma_{comparison['output_column_name']}")


def with_gammas(pairs, comparisons):
    """Pairs plus one gamma column per comparison. Every similarity is computed once, in a column."""
    calls = [call for c in comparisons for level in c["comparison_levels"]
             for call in SIMILARITY_CALL.findall(to_spark_sql(level["sql_condition"]))]
    known = {call: f"_similarity_{i}" for i, call in enumerate(dict.fromkeys(calls))}
    columns = pairs.columns
    if known:
        similarity.register(pairs.sparkSession)
        pairs = pairs.select("*", *[F.expr(call).alias(name) for call, name in known.items()])
    return pairs.select(*columns, *[gamma(c, known) for c in comparisons])


#: Different values of a field up to which its gammas are worked out for all pairs of values beforehand.
FEW_VALUES = 300


def of_few_values(tables, comparisons):
    """{field: (values, gammas)} of the comparisons with similarities or edit distances whose field has few values in the tables: the gamma of the values at
    places i and j is byte i * len(values) + j, less 2. Null is the first value."""
    costly = [c for c in comparisons if any(SIMILARITY_CALL.search(level["sql_condition"]) or "levenshtein(" in level["sql_condition"] for level in c["comparison_levels"])]
    if not costly:
        return {}
    both = tables[0].select(*[c["output_column_name"] for c in costly])
    for other in tables[1:]:
        both = both.unionByName(other.select(*both.columns))
    about, out = both.agg(*[F.approx_count_distinct(f).alias(f) for f in both.columns]).first(), {}
    for c in costly:
        f = c["output_column_name"]
        if about[f] > FEW_VALUES:
            continue
        known = [r[0] for r in both.select(f).where(F.col(f).isNotNull()).distinct().limit(2 * FEW_VALUES).collect()]
        if len(known) == 2 * FEW_VALUES:
            continue
        values = both.sparkSession.createDataFrame(list(enumerate([None, *known])), f"place int, value {dict(both.dtypes)[f]}").repartition(8)
        side = lambda s: values.toDF(f"_place_{s}", f"{f}_{s}")
        try:
            scored = with_gammas(side("l").crossJoin(F.broadcast(side("r"))), [c])
        except AnalysisException:
            continue     # it reads other columns too
        size = len(known) + 1
        table = bytearray(size * size)
        for l, r, g in scored.select("_place_l", "_place_r", f"gamma_{f}").collect():     # FEW_VALUES bounds them
            table[l * size + r] = 0 if g is None else g + 2
        out[f] = (values, size, bytes(table))
    return out


def with_places(records, few):
    """The records with the places of their values as _place_<field>."""
    for f, (values, _, _) in few.items():
        own = values.where("value IS NOT NULL").toDF(f"_place_{f}", f)
        records = records.join(F.broadcast(own), f, "left").withColumn(f"_place_{f}", F.coalesce(f"_place_{f}", F.lit(0)))
    return records


def gamma_of_places(field, few):
    """The gamma column of a comparison from the places of both values."""
    _, size, table = few[field]
    at = F.substring(F.lit(table), F.col(f"_place_{field}_l") * F.lit(size) + F.col(f"_place_{field}_r") + F.lit(1), F.lit(1))
    return (F.nullif(F.ascii(at.cast("string")), F.lit(0)) - 2).alias(f"gamma_{field}")


# A call on a column of one side and literals, worth working out once a record instead of once a pair.
ONE_SIDED = re.compile(r"\b(try_to_date|regexp_extract|substring_index)\(`([^`]+)_([lr])`((?:,\s*(?:'[^'\\]*'|-?\d+))*)\)")


def by_side(comparisons):
    """Columns to make on the records, as {name: SQL}, and the comparisons that read <name>_l and <name>_r instead of making them for every pair."""
    made, out = {}, []

    def column(call):
        function, field, side, rest = call.groups()
        return f"`{made.setdefault(f'{function}(`{field}`{rest})', f'_made_{len(made)}')}_{side}`"

    for c in comparisons:
        levels = [{**level, "sql_condition": ONE_SIDED.sub(column, to_spark_sql(level["sql_condition"]))} for level in c["comparison_levels"]]
        out.append({**c, "comparison_levels": levels})
    return {name: expression for expression, name in made.items()}, out


def level_gammas(comparison):
    """Gamma value of each level, in ladder order."""
    rank = sum(1 for level in comparison["comparison_levels"] if not level.get("is_null_level"))
    values = []
    for level in comparison["comparison_levels"]:
        if level.get("is_null_level"):
            values.append(-1)
        else:
            rank -= 1
            values.append(rank)
    return values
