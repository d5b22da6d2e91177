"""Benchmark decontamination: which documents contain which test items.

Containment of a short item in a long document is searched with MinHash sketches of the items alone: a sketch is the item's
smallest shingle hashes, and a document is a candidate if it holds enough of them. Items are partitioned by size; the
sketch of a partition is so long that a document with the wanted containment cannot miss all of it, however long the
document is. Candidates are verified by exact containment of the item's shingle set. DataFrame functions only.
"""
from pyspark.sql import functions as F

from kinsift.llm.common import keys, let, lower_ascii, row_key, words
from kinsift.session import materialise

#: Places of the bounded filter that document shingles pass before they are exploded; one byte each, 64 KB in the plan.
FILTER_PLACES = 1 << 16


def shingles(text, n=5):
    """Distinct hashes of the n-word shingles of a text, A-Z lower-cased. A shorter text is one shingle, distinct from any
    longer run; a text without words has none."""
    def windows(hashed):
        many = F.transform(F.sequence(F.lit(0), F.size(hashed) - n), lambda i: F.xxhash64(*[F.get(hashed, i + F.lit(k)) for k in range(n)]))
        return F.when(F.size(hashed) >= n, F.array_distinct(many)).when(F.size(hashed) > 0, F.array(F.xxhash64(F.lit("short"), hashed))).otherwise(
            F.array().cast("array<long>"))

    return let(F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w)), windows)


def sketches(items, threshold):
    """(hash, item_key, needed): the sketch of each item, and how many of its hashes a document must hold.

    Size partition c holds items of 2**c to 2**(c+1) - 1 shingles. An item of m shingles may lack m - ceil(threshold * m) of
    them, so a sketch one longer than the partition's largest such number always meets a containing document, and all
    beyond the item's own number are further meetings that a candidate needs.
    """
    m = F.size("shingles")
    largest = F.pow(F.lit(2.0), F.floor(F.log2(m)) + 1) - 1
    length = F.least(m, (largest - F.ceil(largest * threshold - 1e-9) + 1).cast("int"))
    lacking = m - F.ceil(m * F.lit(threshold) - 1e-9)
    sized = items.where(m > 0).withColumns({"length": length, "needed": (length - lacking).cast("int")})
    return sized.select("item_key", "needed", F.explode(F.slice(F.sort_array("shingles"), F.lit(1), F.col("length"))).alias("hash"))


def contained_items(documents, items, threshold=0.75, n=5, doc_id="doc_id", item_id="item_id", text="text"):
    """Pairs (doc_id, item_id, n_shared, n_item, containment) with containment >= threshold; a row per document and item row.

    n_item is the item's number of distinct shingles, n_shared how many of them the document has. Null, empty and wordless
    texts contain nothing and are contained in nothing; an item of fewer than n words is found only in a document that is that
    word sequence; repeated documents and items each give rows; null ids stay null; empty tables give no rows; other
    columns are not looked at. Texts are told apart by digest, so copies are searched once per partition of the scan and verified once.
    """
    wanted = materialise(items.select(F.col(item_id).alias("item_id"), row_key(item_id, text).alias("item_key"), shingles(F.col(text), n).alias("shingles")))
    unique = wanted.select("item_key", "shingles").dropDuplicates(["item_key"])
    sketch = materialise(sketches(unique, threshold))
    every = materialise(unique.select("item_key", F.size("shingles").alias("n_item"), F.explode("shingles").alias("hash")))
    hashes = materialise(every.select("hash").distinct())
    marks = bytearray(FILTER_PLACES)
    for row in hashes.select(F.pmod("hash", F.lit(FILTER_PLACES)).cast("int")).distinct().collect():
        marks[row[0]] = 1
    passes = F.lit(bytes(marks))
    body = documents.select(F.md5(F.col(text)).alias("text_key"), F.col(text).alias("text")).where("text IS NOT NULL")
    near = F.filter(shingles(F.col("text"), n), lambda h: F.substr(passes, F.pmod(h, F.lit(FILTER_PLACES)).cast("int") + F.lit(1), F.lit(1)) == F.lit(b"\x01"))
    held = materialise(body.select("text_key", F.explode(near).alias("hash")).join(hashes, "hash").distinct())
    met = (held.join(sketch, "hash").groupBy("text_key", "item_key")
           .agg(F.count(F.lit(1)).alias("met"), F.first("needed").alias("needed")).where("met >= needed"))
    exact = (held.join(every, "hash").join(met.select("text_key", "item_key"), ["text_key", "item_key"])
             .groupBy("text_key", "item_key").agg(F.count(F.lit(1)).cast("int").alias("n_shared"), F.first("n_item").alias("n_item"))
             .where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - 1e-9)))
    found = materialise(exact)
    named = documents.select(F.col(doc_id).alias("doc_id"), F.md5(F.col(text)).alias("text_key")).join(found, "text_key")
    return (named.join(wanted.select("item_key", "item_id"), "item_key")
            .select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")))


def without_contaminated(documents, items, threshold=0.75, n=5, text="text"):
    """The rows of `documents` that contain no item, with all their columns; null and empty texts stay."""
    found = contained_items(documents.select(F.md5(F.col(text)).alias("doc_id"), F.col(text).alias("text")),
                            items, threshold, n).select(F.col("doc_id").alias("bad_text")).distinct()
    return documents.join(keys(found), F.md5(F.col(text)) == F.col("bad_text"), "left_anti")
