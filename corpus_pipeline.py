"""A corpus from raw documents: five operators in turn, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. A caller
writes each result as Parquet and reads it again as the next stage's docs, as run() does.

All stages: an empty table gives an empty one; null ids, sources and texts are allowed; rows of one id are separate documents; ties
are settled by id, then by text, so reruns agree; other columns are carried, whatever their names.
"""
from pyspark.sql import functions as F

from kinsift.llm import common
from kinsift.llm.decontaminate import without_contaminated
from kinsift.llm.line_dedup import dedup_units
from kinsift.llm.mixing import mix
from kinsift.llm.ngram_join import keep_one
from kinsift.llm.quality_rules import keep_good
from kinsift.session import materialise, release


def quality(spark, docs, sf_dir):
    """Documents that the weakly supervised rules reject go, null and empty texts among them; the rest stays as it is."""
    return keep_good(docs)


def near_copies(spark, docs, sf_dir):
    """One document of each group of near copies stays: the one with the smallest id, null last. Texts without words all stay."""
    return keep_one(docs)


def substrings(spark, docs, sf_dir):
    """Passages of 25 words or more that an earlier document has go out of the text, n_chars follows; a document without words, or
    left without, goes."""
    cut = dedup_units(docs).select(*docs.columns)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.where(common.n_words(F.col("text")) > 0)


def decontamination(spark, docs, sf_dir):
    """Documents that contain a benchmark item go; null and empty texts contain none."""
    return without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    """How often the mix takes each document that is left: copies, and words with repeats counted; a null text has size 0 and a null source
    is a source of its own, the last."""
    sized = docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size"))
    return mix(materialise(sized)).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_copies), ("substring_dedup", substrings),
          ("benchmark_decontamination", decontamination), ("mixing", mixing)]
#: SQL cannot say the first and the last stage; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
