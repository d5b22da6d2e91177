"""Quality rules as weak supervision: rules vote or abstain, EM estimates how often each is right, and the posterior
probability of good text decides, in place of a filter that every rule must pass.

Built from DataFrame functions only. Features are computed inside each row, so no text is shuffled; what meets in a
shuffle are vote patterns, at most 3 to the power of the number of rules.
"""
import math

from pyspark.sql import functions as F

from kinsift.llm.common import SPACE_CHARS, let, words
from kinsift.session import materialise

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Frequent short words of the four languages of the corpus: fixed values.
FUNCTION_WORDS = ("the of and to in is that for with on as was are by an or from at "
                  "de la el los las que y en un se por para con del su al como "
                  "le les des et une du est dans pour qui sur par au pas ce "
                  "der die und das ist von zu den mit dem ein eine auf für nicht als").split()


def repeated_words(tokens):
    """Words that lie in an 8-word window found at least twice in the text, the first finding included.

    Windows are compared by hash; those with an equal neighbour in sorted order are repeated, and the words they
    cover are counted from one start to the next. The work is that of a sort, however often a window repeats.
    """
    def windows(hashed):
        return F.transform(F.sequence(F.lit(0), F.size(hashed) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(hashed, i + F.lit(k)) for k in range(WINDOW)]))

    def same(ordered):
        return F.filter(ordered, lambda x, j: (F.get(ordered, j - 1)["h"] == x["h"]) | (F.get(ordered, j + 1)["h"] == x["h"]))

    def covered(starts):
        steps = F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def count(hashes):
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(ordered, lambda o: F.sort_array(F.transform(same(o), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(starts, covered)).otherwise(F.lit(0).cast("long"))

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) > WINDOW, let(let(hashed, windows), count)).otherwise(F.lit(0).cast("long"))


def measured(text):
    """Name to column: the counts that the rules look at, those of words and of lines as structs. A null text counts as empty."""
    body = F.coalesce(text, F.lit(""))
    solid = F.translate(body, SPACE_CHARS, "")

    def of_words(tokens):
        return F.struct(
            F.size(tokens).cast("long").alias("words"), repeated_words(tokens).alias("repeat"),
            F.size(F.filter(tokens, lambda w: F.lower(w).isin(FUNCTION_WORDS))).cast("long").alias("function"))

    def of_lines(lines):
        return F.struct(F.size(lines).cast("long").alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup_lines"))

    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    return {"f_w": let(words(text), of_words), "f_l": let(lines, of_lines),
            "f_chars": F.length(solid).cast("long"),
            "f_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            "f_plain": F.length(F.regexp_replace(solid, r"[^\p{L}]", "")).cast("long")}


#: Where `measured` has the counts that are parts of structs.
PARTS = {f"f_{c}": ("f_w", c) for c in ("words", "repeat", "function")} | {f"f_{c}": ("f_l", c) for c in ("n_lines", "dup_lines")}


def features(documents, text="text"):
    """`documents` with f_*: counts that the rules look at. A null text counts as empty."""
    made = documents.select("*", *[column.alias(name) for name, column in measured(F.col(text)).items()])
    return made.withColumns({name: F.col(".".join(part)) for name, part in PARTS.items()}).drop("f_w", "f_l")


def _vote(good, bad):
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("byte")


def votes(of=F.col):
    """Name to vote: 1 good, -1 bad, 0 abstains. Shares are of words or of the text's non-space characters; `of` gives a count by name."""
    n, c = of("f_words"), of("f_chars")
    some = n > 0
    return {
        "v_length": _vote(n >= 50, n < 20),
        "v_word_length": _vote(some & (c >= 3 * n) & (c <= 9 * n), (n == 0) | (c < 2 * n) | (c > 14 * n)),
        "v_symbols": _vote(some & (100 * of("f_symbols") <= 2 * n), 10 * of("f_symbols") > 2 * n),
        "v_lines": _vote((of("f_n_lines") >= 3) & (10 * of("f_dup_lines") <= of("f_n_lines")),
                         10 * of("f_dup_lines") > 3 * of("f_n_lines")),
        "v_repeats": _vote((n >= 20) & (100 * of("f_repeat") <= 10 * n), 100 * of("f_repeat") > 30 * n),
        "v_letters": _vote(some & (100 * of("f_plain") >= 85 * c), 100 * of("f_plain") < 70 * c),
        "v_function": _vote(some & (100 * of("f_function") >= 5 * n), (n >= 20) & (100 * of("f_function") < n)),
    }


START = {"good": 0.9, "bad": 0.6}
BOUNDS = {"good": (0.7, 0.99), "bad": (0.4, 0.99)}


def learn(patterns, rules, rounds=50, prior=0.9, strength=20.0):
    """Prior of good text and two accuracies of each rule, by EM over vote patterns: [(votes in order of `rules`, n)].

    accuracy["good"] is the chance that a rule which votes on good text votes 1, accuracy["bad"] that on bad text it votes
    -1; the two differ, for most rules catch one kind of bad text only. `strength` votes at the starting accuracy stand behind
    each rule, so a rule that hardly votes keeps it; the bounds keep a rule's vote from counting against itself. No
    patterns give the starting values.
    """
    model = {"prior": prior, "accuracy": {r: dict(START) for r in rules}}
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        up, down, base = _odds(model)
        shares = [(votes, n, 1 / (1 + math.exp(-base - sum(up[r] if v > 0 else down[r] if v < 0 else 0 for r, v in zip(rules, votes)))))
                  for votes, n in patterns]
        new = {"prior": min(0.98, max(0.02, (sum(n * p for _, n, p in shares) + strength * prior) / (total + strength))), "accuracy": {}}
        for j, r in enumerate(rules):
            new["accuracy"][r] = {}
            for kind, sign in (("good", 1), ("bad", -1)):
                weight = [(votes[j], n * (p if kind == "good" else 1 - p)) for votes, n, p in shares if votes[j]]
                share = (sum(w for v, w in weight if v == sign) + strength * START[kind]) / (sum(w for _, w in weight) + strength)
                new["accuracy"][r][kind] = min(BOUNDS[kind][1], max(BOUNDS[kind][0], share))
        model = new
    return model


def _odds(model):
    """Log odds that a vote for and a vote against add, by rule, and those of the prior."""
    up = {r: math.log(a["good"] / (1 - a["bad"])) for r, a in model["accuracy"].items()}
    down = {r: math.log((1 - a["good"]) / a["bad"]) for r, a in model["accuracy"].items()}
    return up, down, math.log(model["prior"] / (1 - model["prior"]))


def posterior(model, of=F.col):
    """Probability of good text given the votes; a rule that abstains says nothing. `of` gives a vote by name."""
    up, down, base = _odds(model)
    odds = F.lit(base)
    for rule in up:
        odds = odds + F.when(of(rule) > 0, F.lit(up[rule])).when(of(rule) < 0, F.lit(down[rule])).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def fit(voted):
    """Model from rows with votes. Spark folds the rows to vote patterns before the shuffle; what comes to the driver is
    at most 3 to the power of the number of rules (2187) rows, whatever the input, and EM runs over those."""
    rules = list(votes())
    patterns = voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).orderBy(*rules).collect()
    return learn([(tuple(row[r] for r in rules), row["n"]) for row in patterns], rules)


def base_failed(of=F.col):
    """Too short, or mostly repeated windows: no vote outweighs these."""
    return (of("f_words") < 20) | (100 * of("f_repeat") > 30 * of("f_words"))


def judge(voted, model, threshold=0.5):
    """Votes to quality (posterior), base_failed and kept."""
    return (voted.withColumn("quality", posterior(model)).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))


def score(documents, keep=("doc_id",), text="text"):
    """Features, votes, quality and verdict of every row; one pass over the texts, whose narrow result is stored.

    Null and empty texts have no words and fail the base rule; repeated rows are judged alike; an empty table gives an
    empty result. Columns of `documents` beyond `keep` are not carried.
    """
    voted = materialise(features(documents.select(*keep, F.col(text).alias("f_text")), "f_text").drop("f_text").withColumns(votes()))
    return judge(voted, fit(voted))


def verdict(text, model, threshold=0.5):
    """Whether a text is kept, as `judge` says, in one expression. Its counts are bound once: a filter on columns made beforehand is moved
    below them by Spark, and would work out each count anew wherever a rule names it."""
    def judged(found):
        def count(name):
            whole, *part = PARTS.get(name, (name,))
            return found[whole][part[0]] if part else found[whole]

        return ~base_failed(count) & (posterior(model, votes(count).get) >= threshold)

    return let(F.struct(*[column.alias(name) for name, column in measured(text).items()]), judged)


def keep_good(documents, text="text"):
    """The rows of `documents` that are kept, with their own columns. The model is learned in one pass and applied in
    a second one, so texts are neither shuffled nor stored. No column is added, so none is in the way, whatever its name."""
    model = fit(features(documents.select(F.col(text).alias("f_text")), "f_text").withColumns(votes()))
    return documents.where(verdict(F.col(text), model))
