"""Substring deduplication by hashing pieces of lines: a passage that occurs more than once stays where it ranks first.

A piece is a stretch of a line up to a mark that ends a sentence or clause; long ones are cut again after words whose own checksum
says so. Equal passages are thus cut alike wherever they begin. A unit is as many whole pieces as make MIN_WORDS words; one
begins at every piece. Units are normalised (A-Z lower-cased, white space collapsed) and hashed; digests meet in blocks, packed, and
only those that occur more than once come back and are grouped globally, folded on the map side, so a passage that a third of
all texts share is one row of each task there. The pieces of every unit that ranks after an equal one go, and so do the words next to a run
of them, up to EDGE on either side, that equal those next to the first occurrence: a passage that starts inside a piece is taken
from its first word. Of texts, only those that lose something are shuffled, once, at the end.
"""
import hashlib
import re
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinsift.llm import dealing
from kinsift.llm.common import BROADCAST_KEYS, arrow_rows
from kinsift.session import materialise, release

#: Words of a unit at least; words beside a run of units that are compared with those beside its first occurrence.
MIN_WORDS, EDGE = 25, 8
#: Pieces of more words are also cut after words whose checksum is a multiple of CUT.
LONG, CUT = 16, 8
#: Characters that go on one unit, at a guess that only decides the number of blocks.
UNIT_CHARS = 32
MARKS = frozenset(".!?,;:")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TO_LOWER = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    """(words in lower case, the first word of each piece and the end of the last)."""
    words, firsts = [], [0]
    for line in text.translate(TO_LOWER).split("\n"):
        own = WORDS.findall(line)
        if not own:
            continue
        base = len(words)
        words += own
        cuts = [base + i for i, word in enumerate(own, 1) if word[-1] in MARKS]
        if not cuts or cuts[-1] < len(words):
            cuts.append(len(words))
        for end in cuts:
            if end - firsts[-1] > LONG:
                firsts += [i + 1 for i in range(firsts[-1], end - 1) if crc32(words[i].encode("utf-8", "surrogatepass")) % CUT == 0]
            firsts.append(end)
    return words, firsts


def unit_ends(firsts, min_words):
    """For each piece, the word after the shortest unit that begins there; None where the text ends before."""
    ends, last = [], 0
    for start in firsts[:-1]:
        while last < len(firsts) and firsts[last] - start < min_words:
            last += 1
        ends.append(firsts[last] if last < len(firsts) else None)
    return ends


def marks_of(words):
    """Two bytes of checksum for each word, and EDGE words of zeros on either side."""
    sums = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words))
    return np.concatenate([np.zeros(EDGE, "<u2"), sums.astype("<u2"), np.zeros(EDGE, "<u2")])


def digests_of(words, firsts, min_words):
    """64-bit digests of the units of a text, one for each of its first pieces."""
    out = []
    for start, end in zip(firsts, unit_ends(firsts, min_words)):
        if end is None:
            break
        out.append(hashlib.blake2b(" ".join(words[start:end]).encode("utf-8", "surrogatepass"), digest_size=8).digest())
    return np.frombuffer(b"".join(out), "<u8")


def _deal(min_words, n_blocks, most):
    """mapInArrow over (rank, key, text): the units of a piece of the corpus, dealt to blocks, with a head (rank, key and number of units
    of its documents). The owner of a unit is its number in the piece."""
    def flush(name, ranks, keys, starts, digests):
        kept = pa.record_batch({"rank": pa.concat_arrays(ranks), "key": pa.array(keys, pa.int32()), "start": pa.array(starts, pa.int32()),
                                "units": pa.array(list(map(len, digests)), pa.int32())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept.schema) as writer:
            writer.write_batch(kept)
        values = np.concatenate(digests)
        return dealing.deal(name, (sink.getvalue().to_pybytes(), b""), values, np.arange(len(values)), n_blocks)

    def run(batches):
        part, number, ranks, keys, starts, digests, held = TaskContext.get().partitionId(), 0, [], [], [], [], 0
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = digests_of(*pieces(text or ""), min_words)
                # A very long text is several entries, each with its own stretch of units.
                for start in range(0, len(found), most):
                    some = found[start:start + most]
                    if held + len(some) > most:
                        yield flush(f"{part}-{number}", ranks, keys, starts, digests)
                        number, ranks, keys, starts, digests, held = number + 1, [], [], [], [], 0
                    ranks.append(batch.column("rank").slice(i, 1))
                    keys.append(batch.column("key")[i].as_py())
                    starts.append(start)
                    digests.append(some)
                    held += len(some)
        if digests:
            yield flush(f"{part}-{number}", ranks, keys, starts, digests)

    return run


def _rows(table):
    """(digest, rank, key, piece) of the units of one piece of the corpus that occur more than once."""
    (head, _), values, owners, _ = dealing.of_piece(table)
    docs = pa.ipc.open_stream(head).read_all().combine_chunks()
    ends = np.cumsum(docs.column("units").to_numpy())
    doc = np.searchsorted(ends, owners, side="right")
    number = owners - np.concatenate([[0], ends[:-1]])[doc] + docs.column("start").to_numpy()[doc]
    at = pa.array(doc)
    return pa.table([pa.array(values.view(np.int64)), docs.column("rank").take(at), docs.column("key").take(at), pa.array(number.astype(np.int32))],
                    ["digest", "rank", "key", "piece"])


def _words_beside(min_words):
    """mapInArrow over (rank, key, text): the checksums of a text's words, where its pieces begin, and where the units end."""
    def run(batches):
        for batch in batches:
            marks, starts, ends = [], [], []
            for text in batch.column("text").to_pylist():
                words, firsts = pieces(text or "")
                marks.append(marks_of(words).tobytes())
                starts.append(firsts)
                ends.append([e for e in unit_ends(firsts, min_words) if e is not None])
            yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("key"), pa.array(marks, pa.binary()), pa.array(starts, pa.list_(pa.int32())),
                                              pa.array(ends, pa.list_(pa.int32()))], ["rank", "key", "marks", "starts", "ends"])
    return run


def _same(a, b):
    return F.col(f"{a}rank").eqNullSafe(F.col(f"{b}rank")) & (F.col(f"{a}key") == F.col(f"{b}key"))


def _of(docs, wanted):
    """`docs` whose rank and key are in `wanted`: by broadcast if these are counted to be few, else all of them, for a join is to come."""
    if wanted.count() > BROADCAST_KEYS:
        return docs
    return docs.join(F.broadcast(wanted.select(F.col("rank").alias("w_rank"), F.col("key").alias("w_key"))), _same("", "w_"), "left_semi")


def repeated_runs(documents, rank, text, min_words):
    """(rank, key, runs), stored: per document that loses something, its runs of units that rank after equal ones.

    A run is (first piece, last piece, piece that the first one equals if that is in the same document or else -1, checksums of the words
    before and after the first occurrence). Rank is (rank column, null last; a hash of the text; piece): reruns agree. Rows
    equal in both rank and text are one document, of which all copies are treated alike.
    """
    docs = documents.select(F.col(rank).alias("rank"), F.hash(text).alias("key"), F.col(text).alias("text"))
    chars = documents.agg(F.sum(F.length(text))).first()[0] or 0
    n_blocks, block, _ = dealing.sizes(chars // UNIT_CHARS)
    name = docs.schema["rank"].dataType.simpleString()
    with arrow_rows(documents.sparkSession, 256):
        dealt = docs.mapInArrow(_deal(min_words, n_blocks, dealing.OWNERS), dealing.DEALT)
        rows = materialise(dealing.sent_back(dealt, 4 * block, dealing.FREQUENT).groupBy("piece").applyInArrow(
            _rows, f"digest long, rank {name}, key int, piece int"))

    place = F.struct(F.col("rank").isNull().alias("last"), "rank", "key", "piece")
    # Stored, so that the join is one of two plain tables and the rows of a hot digest can be split among tasks.
    first = materialise(rows.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first <> final").select("digest", "first"))
    later = rows.join(first, "digest").where(place != F.col("first")).select(
        "rank", "key", "piece", F.col("first.rank").alias("f_rank"), F.col("first.key").alias("f_key"), F.col("first.piece").alias("f_piece")).distinct()
    # Units of one document that follow each other, here and at their first occurrence, are one run.
    shift = F.col("piece") - F.col("f_piece")
    line = Window.partitionBy("rank", "key", "f_rank", "f_key", "shift").orderBy("piece")
    chained = later.repartition("rank", "key").withColumn("shift", shift).withColumn("island", F.col("piece") - F.row_number().over(line))
    runs = materialise(chained.groupBy("rank", "key", "f_rank", "f_key", "shift", "island").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).drop("island"))
    for table in (rows, first):
        release(table)

    own = _same("", "f_")
    apart = runs.where(~own)
    sources = apart.select(F.col("f_rank").alias("rank"), F.col("f_key").alias("key")).distinct()
    with arrow_rows(documents.sparkSession, 256):
        beside = _of(docs, sources).mapInArrow(_words_beside(min_words), f"rank {name}, key int, marks binary, starts array<int>, ends array<int>")
        beside = beside.select(*[F.col(c).alias(f"m_{c}") for c in beside.columns])
        start, end = F.get("m_starts", F.col("a") - F.col("shift")), F.get("m_ends", F.col("b") - F.col("shift"))
        cut_out = lambda word: F.substring("m_marks", 2 * word + 1, F.lit(2 * EDGE))
        # Equal rows of a first occurrence give equal checksums; one is enough.
        told = (apart.join(beside, _same("f_", "m_")).select("rank", "key", "a", "b", F.lit(-1).alias("same"), cut_out(start).alias("before"), cut_out(end + EDGE).alias("after")))
        inside = runs.where(own).select("rank", "key", "a", "b", (F.col("a") - F.col("shift")).alias("same"), F.lit(None).cast("binary").alias("before"), F.lit(None).cast("binary").alias("after"))
        gone = materialise(told.unionByName(inside).groupBy("rank", "key").agg(F.collect_set(F.struct("a", "b", "same", "before", "after")).alias("runs")))
    release(runs)
    return gone


def cut(text, runs, min_words):
    """(text without what the runs take, [(start, end)] in code points of the original). A unit that begins inside its first
    occurrence in the same text stays."""
    words, firsts = pieces(text)
    ends, marks, gone = unit_ends(firsts, min_words), marks_of(words), np.zeros(len(words), bool)

    def take(start, end, before, after, floor):
        """Words start to end go, and those beside them that equal the given ones; nothing under `floor`."""
        left = right = 0
        while left < EDGE and start - left > floor and before[EDGE - 1 - left] == marks[EDGE + start - 1 - left]:
            left += 1
        while right < EDGE and end + right < len(words) and after[right] == marks[EDGE + end + right]:
            right += 1
        gone[start - left:end + right] = True

    for run in runs:
        if run["same"] < 0:
            take(firsts[run["a"]], ends[run["b"]], np.frombuffer(run["before"], "<u2"), np.frombuffer(run["after"], "<u2"), 0)
            continue
        for piece in range(run["a"], run["b"] + 1):
            other = run["same"] + piece - run["a"]
            begin, stop = firsts[other], ends[other]
            if firsts[piece] >= stop:
                take(firsts[piece], ends[piece], marks[begin:begin + EDGE], marks[stop + EDGE:stop + 2 * EDGE], stop)
    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    spans = [found.span() for found in WORDS.finditer(text)]
    removed = [(spans[a][0], spans[b][0] if b < len(words) else len(text)) for a, b in zip(turns[::2], turns[1::2])]
    kept, at = [], 0
    for start, end in removed:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]]), removed


def dedup_units(documents, rank="doc_id", text="text", min_words=MIN_WORDS):
    """`documents` with repeated passages taken out of the text, and what was taken.

    Adds removed: array of (start, end) in code points of the original text, end exclusive, with the white space up to the next word
    that stays; and original_chars. A passage counts from `min_words` words in whole pieces on, so short lines and phrases that recur
    by chance stay. A null text stays null, an empty one or one without words stays as it is; rows of one rank with different
    texts are told apart by a hash of the text; an empty table gives an empty one; columns named removed or original_chars are
    replaced. Two units of different words share a digest of 64 bits with a chance of about 5e-20, two words a checksum beside
    a run with one of 1.5e-5.
    """
    own = [c for c in documents.columns if c not in ("removed", "original_chars")]

    @F.pandas_udf("text string, removed array<struct<start:long,end:long>>")
    def clean(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = [cut(body, found, min_words) for body, found in zip(texts, runs)]
        return pd.DataFrame([(body, [{"start": a, "end": b} for a, b in removed]) for body, removed in out], columns=["text", "removed"])

    # Else a filter on the new text is moved below, with a second run of the function and Python workers for it.
    clean = clean.asNondeterministic()
    gone = repeated_runs(documents, rank, text, min_words)
    boxed = documents.select(F.struct(*own).alias("row"), F.col(rank).alias("own_rank"), F.hash(text).alias("own_key"))
    body = F.col(f"row.{text}")

    def shown(rows, new, removed):
        return rows.select(*[new.alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in own], removed.alias("removed"),
                           F.length(body).cast("long").alias("original_chars"))

    none = F.array().cast("array<struct<start:long,end:long>>")
    if gone.count() > BROADCAST_KEYS:
        # Many texts lose something: all go through one join, and Python sees those alone.
        joined = boxed.join(gone, _same("own_", ""), "left")
        changed, same = joined.where("runs IS NOT NULL"), joined.where("runs IS NULL")
    else:
        few = F.broadcast(gone.select(F.col("rank").alias("w_rank"), F.col("key").alias("w_key")))
        changed = boxed.join(few, _same("own_", "w_"), "left_semi").join(gone, _same("own_", ""))
        same = boxed.join(few, _same("own_", "w_"), "left_anti")
    cleaned = changed.select("row", clean(body, F.col("runs")).alias("now"))
    return shown(cleaned, F.col("now.text"), F.col("now.removed")).unionByName(shown(same, body, none))
