"""Expressions and readers shared by the operators of this folder."""
from contextlib import contextmanager

from pyspark.sql import functions as F

from kinsift.session import materialise

#: Fixed by the contract of the queries: what separates words, and what a word is.
SPACE_CHARS = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column):
    """A-Z in lower case; other letters stay, so that every engine and Python agree."""
    return F.translate(column, UPPER, LOWER)


def words(column):
    """Words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(column):
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(WORD)).cast("long")


def row_key(*columns):
    """A digest of a row's columns that tells nulls from empty strings; equal rows share it."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns]))


#: Rows of a table of keys (some 32 bytes each) up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_KEYS = 500_000


def keys(df):
    """A stored table of keys, marked for broadcast if it is counted to be small."""
    stored = materialise(df)
    return F.broadcast(stored) if stored.count() <= BROADCAST_KEYS else stored


@contextmanager
def arrow_rows(spark, rows):
    """While jobs run inside, Arrow batches hold at most so many rows: whole texts are long rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let(value, body):
    """body(value) with the value computed once: inside nested lambdas Spark evaluates an outer expression anew for
    every element, but not what an enclosing lambda has bound."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
