"""URL filters by host-suffix and path-prefix expressions.

Each URL is expanded into all suffixes of its host at label borders, times the prefixes of its path at the lengths
that occur among the rules. An expression meets a rule by an equi-join on the first characters of their digests; the full
digests then confirm the meeting. Of the rules that fit a URL the longest decides.
"""
from pyspark.sql import functions as F

from kinsift.llm.common import lower_ascii

PREFIX = 8  # hexadecimal characters of the digest that the join compares


def _after_scheme(url):
    """What follows the first ://; null where there is none."""
    start = F.length(F.substring_index(url, "://", 1)) + F.lit(4)
    return F.when(F.instr(url, "://") > 0, F.substr(url, start))


def url_host(url):
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url):
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host, path, lengths):
    """Array of host suffix + path prefix for the given path lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + F.lit(1)), "."))
    cuts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n) if n else F.lit("")) for n in lengths]),
                    lambda p: p.isNotNull())
    return F.when(host != "", F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda p: F.concat(s, p))))))


def filter_urls(pages, rules, default="allow", url="url"):
    """`pages` with host, path, rule and verdict.

    `rules` has host, path, verdict (allow or block). A rule fits its host and all its subdomains if the path starts with
    the rule's path. The longest host + path decides, then the longer host, then block before allow. No rule fits: rule
    is null and the verdict is `default`. A null URL, or one without ://, has an empty host and path and no rule. Repeated
    rows stay; columns of `pages` named host, path, rule or verdict are replaced. Without rules all get the default.

    Each distinct address is judged once, so a URL that holds a third of all rows costs one row beyond the last join.
    The lengths of rule paths come to the driver: at most as many numbers as the longest rule path has characters.
    """
    named = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    rules = (rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"),
                          F.col("verdict").alias("rule_verdict")).where("rule_host <> ''"))
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    if not lengths:
        return named.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    digest = F.sha2("expression", 256)
    keyed = (rules.withColumn("expression", F.concat("rule_host", "rule_path")).withColumn("rule_digest", digest)
             .withColumn("prefix", F.substring("rule_digest", 1, PREFIX)))
    asked = (named.select("host", "path").distinct()
             .select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("expression"))
             .withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, PREFIX)))
    fits = asked.join(keyed.drop("expression"), "prefix").where("digest = rule_digest")
    order = F.struct(F.length("expression"), F.length("rule_host"), (F.col("rule_verdict") == "block"))
    best = (fits.groupBy("host", "path")
            .agg(F.max_by(F.struct(F.col("expression").alias("rule"), F.col("rule_verdict").alias("verdict")), order).alias("best"))
            .select("host", "path", "best.*"))
    kept = [c for c in named.columns if c not in ("host", "path")]
    return (named.join(best, ["host", "path"], "left")
            .select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))
