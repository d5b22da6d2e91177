"""Derive a noisy copy of a record table with known truth.

Every change is driven by a hash of the record id, so a noisy table is the same however it is
partitioned and whenever a task is run again.
"""
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinsift.fixed_values import (BOOKKEEPING, GENDER_SHARES, PLACE_SHORT_FORMS, PRESET_RATES, UNKNOWN_CAP, VALID_CODES)
from kinsift.functions.draws import SPAN, draw, hit, letter, pick
from kinsift.operators.cleaning import parse_date, suffix_b
from kinsift.operators.profiling import classify_field_kind, numbered

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def hash_sample(df, fraction, key="unique_id", seed=42):
    """About `fraction` of the records."""
    return df.where(hit(fraction, "sample", F.col(key), seed))


def blank(value, share, purpose, key, seed=42):
    """No value for a share of the records."""
    return F.when(~hit(share, purpose, key, seed), value)


def typo(value, purpose, key, seed=42):
    """One character replaced by a random letter."""
    place = F.pmod(draw(purpose, key, 1, seed), F.length(value)).cast("int") + 1
    changed = F.overlay(value, letter(draw(purpose, key, 2, seed)), place, F.lit(1))
    return F.when(F.length(value) < 2, value).otherwise(changed)


def email_variant(value, purpose, key, seed=42):
    """Dots dropped, a number added, or another mail domain."""
    user = F.substring_index(value, "@", 1)
    domain = F.substr(value, F.instr(value, "@") + 1)
    number = (F.pmod(draw(purpose, key, 2, seed), F.lit(99)) + 1).cast("string")
    options = F.array(F.concat(F.regexp_replace(user, r"\.", ""), F.lit("@"), domain), F.concat(user, number, F.lit("@"), domain),
                      F.concat(user, F.lit("@gmail.com")), F.concat(user, F.lit("@outlook.com")))
    return F.when(F.instr(value, "@") > 0, pick(options, draw(purpose, key, 1, seed))).otherwise(value)


def email_digit(value, purpose, key, seed=42):
    """A digit from 1 to 9 added to the user part."""
    digit = (F.pmod(draw(purpose, key, 1, seed), F.lit(9)) + 1).cast("string")
    tail = F.substr(value, F.instr(value, "@"))
    return F.when(F.instr(value, "@") > 0, F.concat(F.substring_index(value, "@", 1), digit, tail)).otherwise(F.concat(value, digit))


def short_place(value):
    """Known short form, else the initials of several words."""
    table = F.create_map(*[F.lit(x) for pair in PLACE_SHORT_FORMS.items() for x in pair])
    words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    initials = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.coalesce(F.try_element_at(table, value), F.when(F.size(words) > 1, initials).otherwise(value))


def clipped_place(value):
    """First three letters in capitals; short values get their case swapped."""
    swapped = F.translate(value, UPPER + LOWER, LOWER + UPPER)
    return F.when(F.length(value) > 3, F.upper(F.substring(value, 1, 3))).otherwise(swapped)


def other_code(value, codes, purpose, key, seed=42):
    """A different valid code."""
    every = F.array(*[F.lit(c) for c in codes])
    rest = F.array_remove(every, F.upper(F.trim(value)))
    return F.when(value.isNotNull(), pick(F.when(F.size(rest) > 0, rest).otherwise(every), draw(purpose, key, 1, seed)))


def flip_gender(value, purpose, key, seed=42):
    """M and F swap; anything else becomes one of them."""
    return (F.when(value == "M", "F").when(value == "F", "M")
            .otherwise(pick(F.array(F.lit("M"), F.lit("F")), draw(purpose, key, 1, seed))))


def other_gender(value, purpose, key, seed=42):
    """One of M, F, U that the value does not read as."""
    text = F.upper(value)
    now = F.when(text.contains("M"), "M").when(text.contains("F"), "F").otherwise("U")
    rest = F.array_remove(F.array(F.lit("M"), F.lit("F"), F.lit("U")), now)
    return pick(rest, draw(purpose, key, 1, seed))


def scramble(value, purpose, key, seed=42):
    """About half of the characters replaced by random letters."""
    changed = F.transform(F.split(value, ""), lambda ch, i: F.when(
        F.pmod(draw(purpose, key, i, seed), F.lit(2)) == 0, ch).otherwise(letter(draw(purpose, key, i + 1000, seed))))
    return F.when(F.length(value) <= 1, value).otherwise(F.array_join(changed, ""))


def last_char(value, purpose, key, seed=42):
    """Last character replaced."""
    head = F.substr(value, F.lit(1), F.length(value) - 1)
    return F.when(F.length(value) > 1, F.concat(head, letter(draw(purpose, key, 1, seed)))).otherwise(value)


def change_letters(value, n, purpose, key, seed=42):
    """Exactly n letters changed to other letters, case kept; other characters stay."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))),
                      lambda i: F.substr(value, i, F.lit(1)).rlike(r"\p{L}"))
    ranked = F.array_sort(F.transform(places, lambda i: F.struct(draw(purpose, key, i, seed).alias("h"), i.alias("i"))))
    chosen = F.transform(F.slice(ranked, 1, max(n, 0)), lambda x: x["i"])

    def moved(ch, i):
        step = draw(purpose, key, i + 1000, seed)
        turn = lambda base: F.char(F.pmod(F.ascii(ch) - base + 1 + F.pmod(step, F.lit(25)), F.lit(26)) + base)
        fresh = F.when(F.upper(ch) == ch, letter(step, "A")).otherwise(letter(step, "a"))
        return F.when(ch.rlike("[a-z]"), turn(97)).when(ch.rlike("[A-Z]"), turn(65)).otherwise(fresh)

    # The places are worked out once a value, as the one element of an array; inside the loop over the characters they would be once a character.
    changed = F.element_at(F.transform(F.array(chosen), lambda at: F.transform(F.split(value, ""), lambda ch, i: F.when(
        F.array_contains(at, i + 1), moved(ch, i + 1)).otherwise(ch))), 1)
    return F.when(F.size(places) > 0, F.array_join(changed, "")).otherwise(value)


def shift_date(value):
    """Next month of the same year and next day, held inside the month; unparseable values stay."""
    date = parse_date(F.trim(value))
    first = F.make_date(F.year(date), F.month(date) % 12 + 1, F.lit(1))
    day = F.least(F.dayofmonth(date) + 1, F.dayofmonth(F.last_day(first)))
    return F.coalesce(F.date_format(F.make_date(F.year(first), F.month(first), day), "yyyy-MM-dd"), value)


def shift_year(value, purpose, key, shift=1, seed=42):
    """Year moved up or down; a value that is no whole number stays."""
    year = F.when(F.trim(value).rlike(r"^[+-]?\d{1,9}$"), F.trim(value)).cast("int")
    sign = F.when(F.pmod(draw(purpose, key, 1, seed), F.lit(2)) == 0, F.lit(1)).otherwise(F.lit(-1))
    return F.coalesce((year + sign * shift).cast("string"), value)


def synthetic_code(value, purpose, key, seed=42):
    """A code made from the first two letters: XXn nAB."""
    n = (F.pmod(draw(purpose, key, 1, seed), F.lit(98)) + 1).cast("string")
    return F.concat(F.translate(F.upper(F.substring(value, 1, 2)), " ", "X"), n, F.lit(" "), n, F.lit("AB"))


def weighted_choice(purpose, key, shares=None, seed=42):
    """A label drawn with the given shares."""
    h, edge, out = draw(purpose, key, 0, seed), 0.0, None
    shares = shares or GENDER_SHARES
    for name, share in shares[:-1]:
        edge += share
        test = h < F.lit(int(round(edge * SPAN)))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(shares[-1][0]))


# ---- whole tables -------------------------------------------------------------------------------------

def _corrupt(type_, value, column, key, seed):
    """Corrupted value of a column by its semantic type."""
    if type_ in ("first_name", "surname", "full_name"):
        return scramble(value, column, key, seed)
    if type_ == "dob":
        return F.lit(None).cast("string")
    if type_ == "email":
        return email_digit(value, column, key, seed)
    if type_ in ("location", "postcode"):
        return clipped_place(value)
    if type_ == "gender":
        return other_gender(value, column, key, seed)
    return last_char(value, column, key, seed)


def _as_b(df, types):
    """Truth cluster from the original id, then _B on the id columns and source B."""
    ids = {c for c, t in types.items() if t == "id"} | {"unique_id"}
    out = [suffix_b(F.col(c)).alias(c) if c in ids else F.col(c) for c in df.columns if c not in ("cluster", "source_dataset")]
    return df.select(*out, F.coalesce(F.col("unique_id").cast("string"), F.lit("NA")).alias("cluster"), F.lit("B").alias("source_dataset"))


def derive_b_rates(df, types, fraction=0.5, rates=None, seed=42):
    """A sample of the records where each field is corrupted at its own rate; nulls are never touched."""
    key, rates = F.col("unique_id"), rates or {}
    out = []
    for c in df.columns:
        rate = rates.get(c, 0.0)
        if rate > 0 and types.get(c, "text") != "id" and c not in BOOKKEEPING:
            noisy = _corrupt(types.get(c, "text"), F.col(c), c, key, seed)
            out.append(F.when(hit(rate, f"rate-{c}", key, seed) & F.col(c).isNotNull(), noisy).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return _as_b(hash_sample(df, fraction, seed=seed).select(*out), types)


def derive_b_all_rows(df, types, fraction=0.3, fields=None, letters=2, shift=1, seed=42):
    """A sample of the records where every row of every chosen field is changed, by the kind of field."""
    key = F.col("unique_id")
    fields = [f for f in (fields or df.columns) if f in df.columns and f not in BOOKKEEPING]
    open_fields = [f for f in fields if f not in VALID_CODES]
    sample = hash_sample(df, fraction, seed=seed)
    # one row per field
    kinds = {r["column"]: r["kind"] for r in classify_field_kind(sample, open_fields, parse_date).collect()} if open_fields else {}
    out = []
    for c in df.columns:
        value = F.col(c)
        if c not in fields:
            out.append(value)
        elif c in VALID_CODES:
            out.append(other_code(value, VALID_CODES[c], c, key, seed).alias(c))
        elif kinds.get(c) == "full_date":
            out.append(shift_date(value).alias(c))
        elif kinds.get(c) == "year_only":
            out.append(shift_year(value, c, key, shift, seed).alias(c))
        else:
            out.append(change_letters(value, letters, c, key, seed).alias(c))
    return _as_b(sample.select(*out), types)


def derive_b_preset(df, fraction=0.5, seed=42):
    """A sample with the standard mix of errors on the fields that are present."""
    key = F.col("unique_id")
    change = {
        "first_name": lambda v: typo(v, "first_name", key, seed),
        "surname": lambda v: typo(v, "surname", key, seed),
        "dob": lambda v: F.lit(None).cast("string"),
        "email": lambda v: email_variant(v, "email", key, seed),
        "city": short_place,
        "gender": lambda v: flip_gender(v, "gender", key, seed),
    }
    out = []
    for c in df.columns:
        value = F.col(c)
        if c in PRESET_RATES:
            # a missing gender gets a value; other missing fields stay missing
            struck = hit(PRESET_RATES[c], f"rate-{c}", key, seed) & (F.lit(True) if c == "gender" else value.isNotNull())
            value = F.when(struck, change[c](value)).otherwise(value).alias(c)
        out.append(value)
    b = hash_sample(df, fraction, seed=seed).select(*out)
    cluster = "cluster" if "cluster" in b.columns else "unique_id"
    return b.withColumn("cluster", F.col(cluster)).withColumn("unique_id", suffix_b(F.col("unique_id"))).withColumn("source_dataset", F.lit("B"))


def lookup_enrich(df, key_column, dimension, dim_key, dim_value, out, seed=42):
    """Give every row one of the values listed for its key, by hash; no key or no listing gives null."""
    listed = numbered(dimension.where(F.col(dim_key).isNotNull()).select(F.lower(F.trim(dim_key)).alias("_key"), dim_value).distinct(), "_key", dim_value)
    sizes = listed.groupBy("_key").agg(F.max("n_values").alias("_n"))
    rows = df.withColumn("_key", F.lower(F.trim(F.col(key_column)))).join(sizes, "_key", "left")
    rows = rows.withColumn("_want", F.pmod(draw(out, F.col("unique_id"), 0, seed), F.col("_n")) + 1)
    listed = listed.select("_key", F.col("position").alias("_want"), F.col(dim_value).alias(out))
    return rows.join(listed, ["_key", "_want"], "left").drop("_key", "_want", "_n")


def capped_reassign(df, column="gender", protected="first_name", cap=UNKNOWN_CAP, unknown="Unknown", choices=("M", "F"), seed=42):
    """Where unknown values exceed the cap, give the excess a real value; rows without a name keep theirs.

    The rows taken are those with the smallest draws. Draws are counted in 2^20 buckets, whole
    buckets are taken first and only the bucket at the edge is ranked, so nothing is sorted globally.
    """
    key = F.col("unique_id")
    eligible = (F.col(column) == unknown) & F.col(protected).isNotNull()
    h = draw(f"cap-{column}", key, 0, seed)
    tagged = df.withColumn("_h", F.when(eligible, h)).withColumn("_bucket", F.shiftright("_h", 12))
    buckets = tagged.where("_bucket is not null").groupBy("_bucket").agg(F.count("*").alias("_n"))
    totals = df.agg((F.count_if(F.col(column) == unknown) - F.floor(F.lit(cap) * F.count("*"))).alias("_excess"))
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (buckets.withColumn("_sum", F.sum("_n").over(running)).withColumn("_one", F.lit(1))
           .join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one"))
    cut = cut.select("_bucket", "_n", F.greatest(F.least("_n", F.col("_excess") - F.col("_sum") + F.col("_n")), F.lit(0)).alias("_take"))
    marked = tagged.join(F.broadcast(cut), "_bucket", "left")      # at most 2^20 buckets
    edge = F.coalesce((F.col("_take") > 0) & (F.col("_take") < F.col("_n")), F.lit(False))
    order = Window.partitionBy("_bucket").orderBy("_h", "unique_id")
    ranked = marked.where(edge).withColumn("_taken", F.row_number().over(order) <= F.col("_take"))
    whole = marked.where(~edge).withColumn("_taken", F.coalesce(F.col("_take") > 0, F.lit(False)))
    value = pick(F.array(*[F.lit(c) for c in choices]), draw(f"cap-value-{column}", key, 0, seed))
    return (whole.unionByName(ranked).withColumn(column, F.when(F.col("_taken"), value).otherwise(F.col(column)))
            .select(*df.columns))
