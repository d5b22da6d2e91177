"""N-gram Jaccard join: documents whose sets of word n-grams are alike, and the groups that such links make.

Documents with equal sets are one class. A set is ordered rare shingles first; two sets that are alike enough must share a shingle
of their prefixes, so only prefixes meet, by an equi-join on the shingle. Length, positional and suffix filters (Xiao et
al., Efficient Similarity Joins for Near Duplicate Detection, 2011) drop meetings before a pair is verified once, on whole sets.

How rare a shingle is comes from its exact count over all classes. Tasks deal packed arrays of their shingles to blocks of the
range of hashes, whose number follows the counted shingles; a block sends back, to the piece of the corpus they come from, those
that occur more than once. All others come first in every order and match nothing. So a prefix is the rarest of the shared
shingles, a document with too many shingles of its own is done, and what is left of a set, its shared shingles, is enough
for every later test. Texts are read twice and never shuffled.

A group of k classes that share a shingle is not expanded into its k * k pairs. First every class meets the group's leader (the class
whose shingles are the most common, which is likely to be the original; a large group is cut into parts with a leader each).
Verified links make components; after that only pairs of classes in different components are candidates, and they are made
from the members outside the group's largest component, as far as the outlines of their sets leave room for a link. A pair left out that way is connected already, so components are those
of all links.

`class_links` is the join itself: it verifies every candidate pair of classes and returns all links. Components need far
fewer, so `near_duplicates` stands beside it.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinsift.llm import dealing
from kinsift.llm.arrays import pieces, shingle_set, word_hashes
from kinsift.llm.common import BROADCAST_KEYS, arrow_rows, keys
from kinsift.operators.components import component_labels
from kinsift.session import materialise, release

#: Shingles that a block counts on average at least, that a task deals at once, and up to which counts are told apart.
BLOCK_SHINGLES, PIECE_SHINGLES, FREQUENT = dealing.BLOCK_NUMBERS, dealing.PIECE_NUMBERS, dealing.FREQUENT
SUFFIX_PARTS, PART_LIMIT = 4, 0xFFFF
#: Classes of one shingle that a tile of the join holds on a side: at most four million pairs, whatever the group.
TILE_ROWS = 2_000
#: Rows of one shingle that are put before one leader; a shingle with more has several leaders.
GROUP_ROWS = 100_000


def prefix_length(size, percent):
    """A set of `size` shares at least ceil(percent * size / 100) shingles with any set that is alike enough."""
    return size - (percent * size + 99) // 100 + 1


def suffix_counts(ordered, length):
    """For each prefix position, how many later shingles fall into each of four ranges of hashes; 16 bits a range, held
    at PART_LIMIT, which stands for that many or more."""
    part = (ordered >> np.uint64(62)).astype(np.int64)
    after = np.bincount(part, minlength=SUFFIX_PARTS) - np.cumsum(part[:length, None] == np.arange(SUFFIX_PARTS), axis=0)
    held = np.minimum(after, PART_LIMIT).astype(np.uint64)
    packed = np.zeros(length, dtype=np.uint64)
    for k in range(SUFFIX_PARTS):
        packed |= held[:, k] << np.uint64(16 * k)
    return packed.view(np.int64)


def digest_of(shingles):
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(column, n):
    """Shingle sets of all texts of an Arrow column, a list for each piece."""
    for _, texts in pieces(column):
        hashes, first = word_hashes(texts)
        yield [shingle_set(hashes[first[i]:first[i + 1]], n) for i in range(len(texts))]


def _describe(documents, n, doc_id, text):
    """One pass over the texts: (doc_id, text_key, n_shingles, digest) a row; the digest names the class, null for an empty set."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [(len(s), digest_of(s).hex() if len(s) else None) for sets in _sets(batch.column(2), n) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k for k, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())],
                                             names=["doc_id", "text_key", "n_shingles", "digest"])

    return (documents.select(F.col(doc_id).alias("doc_id"), F.md5(F.col(text)).alias("text_key"), F.col(text).alias("body"))
            .mapInArrow(run, f"doc_id {kind}, text_key string, n_shingles long, digest string"))


def _firsts(documents, members, doc_id, text):
    """The texts of `documents` that stand first in their class. Rows equal in id and text all stay."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    rows = members.where("digest IS NOT NULL").select("digest", place.alias("place"))
    firsts = rows.groupBy("digest").agg(F.min("place").alias("first"), F.max("place").alias("final")).where("first <> final").select("digest", "first")
    copies = materialise(rows.join(firsts, "digest").where("place <> first").select(F.col("place.doc_id").alias("copy_id"), F.col("place.text_key").alias("copy_key")).distinct())
    few = copies.count() <= BROADCAST_KEYS
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.md5(F.col(text)).alias("text_key"), F.col(text).alias("body"))
    same = F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.col("text_key") == F.col("copy_key"))
    left = docs.join(F.broadcast(copies) if few else copies, same, "left_anti")
    # A piece that is dealt again after a loss must be the same piece: rows that came through a shuffle are put in order.
    return (left if few else left.sortWithinPartitions("text_key", "doc_id")).select("body"), copies


def _deal(n, n_blocks, most):
    """mapInArrow over texts: the shingles of a piece of the corpus, dealt to blocks, with a head (classes, sizes).

    A class that recurs in a piece is passed over. The owner of a shingle is its document's number in the piece.
    """
    def flush(name, sets, digests):
        sizes = np.fromiter(map(len, sets), "<i4", len(sets))
        return dealing.deal(name, (b"".join(digests), sizes.tobytes()), np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes), n_blocks)

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        sets, digests, seen, held = [], [], set(), 0
        for batch in batches:
            for some in _sets(batch.column(0), n):
                for found in some:
                    digest = digest_of(found)
                    if not len(found) or digest in seen:
                        continue
                    seen.add(digest)
                    sets.append(found)
                    digests.append(digest)
                    held += len(found)
                    if held >= most or len(sets) > dealing.OWNERS:
                        yield flush(f"{part}-{number}", sets, digests)
                        sets, digests, seen, held, number = [], [], set(), 0, number + 1
        if sets:
            yield flush(f"{part}-{number}", sets, digests)

    return run


NEAR = "digest string, class long, size int, shared int, central double, prefix array<long>, suffix array<long>, shingles array<long>, marks array<long>"
#: Bits of the outline of a set, 64 in each number.
OUTLINE = 16


def outline(shingles):
    """A bit for each of 1024 places that a shingle of the set falls on."""
    bits = np.zeros(64 * OUTLINE, bool)
    bits[(shingles >> np.uint64(20)) & np.uint64(64 * OUTLINE - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def outlines_pass(percent, a="a", b="b"):
    """Two sets have in common at most the places that both outlines have, and what fell on a place that was taken."""
    count = lambda x: " + ".join(f"bit_count({x.format(i)})" for i in range(OUTLINE))
    both = count(f"{a}.marks[{{0}}] & {b}.marks[{{0}}]")
    return f"{100 + percent} * ({both} + least({a}.taken, {b}.taken)) >= {percent} * ({a}.size + {b}.size)"




def _order_piece(percent):
    """Per document of a piece that may have a partner: its class, the size of its set, and of its shared shingles, rarest first, the
    prefix with what comes after each; central is how common they are."""
    def run(table):
        (digests, sizes), values, owners, counts = dealing.of_piece(table)
        sizes = np.frombuffer(sizes, "<i4")
        order = np.lexsort((values, counts, owners))
        values, owners, counts = values[order], owners[order], counts[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(owners)) + 1, [len(owners)]]) if len(owners) else np.zeros(1, int)
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            owner = int(owners[a])
            size, ordered = int(sizes[owner]), values[a:b]
            # Shingles of its own come first in a prefix and meet nobody.
            length = prefix_length(size, percent) - (size - len(ordered))
            if length > 0:
                digest = digests[16 * owner:16 * owner + 16]
                out.append((digest.hex(), int.from_bytes(digest[:8], "little", signed=True), size, len(ordered), float(counts[a:b].sum()) / size,
                            ordered[:length].view(np.int64), suffix_counts(ordered, length), ordered.view(np.int64), outline(ordered)))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64()] + [pa.list_(pa.int64())] * 4
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.split(" ")[0] for x in NEAR.split(", ")])

    return run


def passes(percent, a="a", b="b"):
    """Length, positional and suffix filter on two prefix rows of one shingle, over shared shingles: those before the shared one can
    only meet among themselves, those after it likewise, and in the suffix only within the same range of hashes."""
    low, high = f"least({a}.size, {b}.size)", f"greatest({a}.size, {b}.size)"
    before = f"least({a}.position, {b}.position) + 1"
    after = f"least({a}.shared - {a}.position, {b}.shared - {b}.position) - 1"
    parts = []
    for k in range(SUFFIX_PARTS):
        x, y = (f"(shiftrightunsigned({s}.suffix, {16 * k}) & {PART_LIMIT})" for s in (a, b))
        parts.append(f"if({x} = {PART_LIMIT} AND {y} = {PART_LIMIT}, 2147483647L, least({x}, {y}))")
    wanted = f"{percent} * ({a}.size + {b}.size)"
    return (f"100 * {low} >= {percent} * {high} AND {100 + percent} * ({before} + {after}) >= {wanted}"
            f" AND {100 + percent} * ({before} + {' + '.join(parts)}) >= {wanted}")


def _verify(pairs, near, percent):
    """Links (digest_l, digest_r) among candidate pairs (class_l, class_r): one exact test a pair. Shingles that two sets have in common
    are shared ones, so these are all that is needed."""
    named = {s: near.select(*[F.col(c).alias(f"{c}_{s}") for c in ("class", "digest", "size", "shingles")]) for s in "lr"}
    both = F.size(F.array_intersect("shingles_l", "shingles_r"))
    return (named["r"].join(pairs, "class_r").join(named["l"], "class_l")
            .where((100 + percent) * both >= percent * (F.col("size_l") + F.col("size_r"))).select("digest_l", "digest_r").distinct())


def _labels(links):
    return component_labels(links.select(F.col("digest_l").alias("node_l"), F.col("digest_r").alias("node_r")))


def _meetings(documents, n, percent, doc_id, text):
    """The described rows; a row for each class that may have a partner; and the prefix rows of shingles that several classes have
    in their prefixes."""
    members = materialise(_describe(documents, n, doc_id, text))
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    n_blocks, block, piece = dealing.sizes(total, BLOCK_SHINGLES, PIECE_SHINGLES)
    texts, copies = _firsts(documents, members, doc_id, text)
    with arrow_rows(documents.sparkSession, 64):
        shared = dealing.sent_back(texts.mapInArrow(_deal(n, n_blocks, piece), dealing.DEALT), 4 * block, FREQUENT)
        near = materialise(shared.groupBy("piece").applyInArrow(_order_piece(percent), NEAR).dropDuplicates(["digest"]))
    release(copies)
    rows = near.select("class", "size", "shared", "central", F.posexplode(F.arrays_zip("prefix", "suffix")).alias("position", "at")).select(
        F.col("at.prefix").alias("shingle"), "class", "size", "shared", "central", "position", F.col("at.suffix").alias("suffix"))
    several = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return members, near, rows.join(several, "shingle")


def _tiles(rows, percent):
    """All pairs (class_l, class_r) of classes that share a prefix shingle and pass the filters, each once.

    A shingle of more than TILE_ROWS classes is cut into chunks, and every two chunks meet in a tile of their own, so no task
    holds a whole group."""
    sizes = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > TILE_ROWS)
    cut = (rows.join(sizes, "shingle", "left").withColumn("chunks", F.coalesce(F.ceil(F.col("k") / F.lit(TILE_ROWS)), F.lit(1)).cast("int"))
           .withColumn("chunk", F.pmod(F.hash("class"), F.col("chunks"))).drop("k"))
    a = cut.withColumns({"low": F.col("chunk"), "high": F.explode(F.sequence("chunk", F.col("chunks") - 1))}).alias("a")
    b = cut.withColumns({"high": F.col("chunk"), "low": F.explode(F.sequence(F.lit(0), F.col("chunk")))}).alias("b")
    met = a.join(b, F.expr(f"a.shingle = b.shingle AND a.low = b.low AND a.high = b.high AND (a.low < a.high OR a.class < b.class) AND {passes(percent)}"))
    return met.select(F.least("a.class", "b.class").alias("class_l"), F.greatest("a.class", "b.class").alias("class_r")).distinct()


def class_links(documents, n=5, percent=75, doc_id="doc_id", text="text"):
    """class_l and class_r (class_l < class_r) of every two different shingle sets that link, each pair once.

    Every candidate pair is verified, whatever other links its component has. Links, sets and classes are those of
    `near_duplicates`, whose rows say which documents are in a class; documents of one class are alike and no pair here. Null and empty texts, and texts
    without words are in no pair; an empty table gives an empty result. A group of k near copies gives up to k * k / 2 rows.
    """
    members, near, met = _meetings(documents, n, percent, doc_id, text)
    rows = materialise(met.drop("k"))
    links = _verify(_tiles(rows, percent), near, percent)
    out = materialise(links.select(F.least("digest_l", "digest_r").alias("class_l"), F.greatest("digest_l", "digest_r").alias("class_r")).distinct())
    for table in (rows, members, near):
        release(table)
    return out


def link_counts(documents, n=5, percent=75, doc_id="doc_id", text="text"):
    """class, n_links of every class that links with another: the number of other classes it links with. Nulls, empty texts, repeated rows,
    ties and empty tables are as in `class_links`, which reads the two columns named and no others."""
    links = class_links(documents, n, percent, doc_id, text)
    ends = links.select(F.explode(F.array("class_l", "class_r")).alias("class"))
    return ends.groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))


def near_duplicates(documents, n=5, percent=75, doc_id="doc_id", text="text"):
    """doc_id, n_shingles, component_id, class and component of every row.

    Two documents link when 100 * shared shingles >= percent * all their shingles. n_shingles is the size of a document's
    set; class names its set, component the smallest class it is linked with over any number of links, component_id the
    smallest doc_id there. Words are split at ASCII white space, A-Z lower-cased; a text of fewer than n words is one shingle. Null,
    empty and wordless texts have an empty set, no class, and are linked with nothing: component_id is their own id. Null
    ids are passed over when the smallest id is sought; repeated rows and repeated ids stay; an empty table gives an empty
    result; other columns are not looked at.
    """
    members, near, met = _meetings(documents, n, percent, doc_id, text)
    group = Window.partitionBy("shingle", "salt")
    row = F.struct("class", "size", "shared", "position", "suffix")
    rows = materialise(met.withColumn("salt", F.pmod("class", F.ceil(F.col("k") / F.lit(GROUP_ROWS)))).drop("k")
                       .withColumn("a", F.max_by(row, F.struct("central", "class")).over(group)).drop("central"))
    led = rows.where("class <> a.class").withColumn("b", row).where(passes(percent))
    first = led.select(F.col("a.class").alias("class_l"), F.col("class").alias("class_r")).distinct()
    links = materialise(_verify(first, near, percent))

    # Pairs that no leader has settled: of one group, but of different components so far.
    labels = _labels(links)
    placed = near.select("class", "digest").join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("class", F.coalesce("label", "digest").alias("part"))
    held = F.expr(" + ".join(f"bit_count(marks[{i}])" for i in range(OUTLINE)))
    outlines = near.select("class", "marks", (F.col("shared") - held).alias("taken"))
    rest = rows.drop("a", "salt").join(placed, "class")
    parts = rest.groupBy("shingle", "part").agg(F.count(F.lit(1)).alias("k"))
    mixed = parts.groupBy("shingle").agg(F.max_by("part", F.struct("k", "part")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    rest = materialise(rest.join(mixed.select("shingle", "main"), "shingle").join(outlines, "class"))
    a, b = rest.where("part <> main").alias("a"), rest.alias("b")
    open_pairs = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & F.expr(
        f"a.part <> b.part AND (b.part = b.main OR a.class < b.class) AND {passes(percent)} AND {outlines_pass(percent)}"))
    second = materialise(open_pairs.select(F.least("a.class", "b.class").alias("class_l"), F.greatest("a.class", "b.class").alias("class_r")).distinct())
    release(rest)
    release(rows)
    if not second.isEmpty():
        one, links = links, materialise(links.unionByName(_verify(second, near, percent)))
        release(one)
        labels = _labels(links)
    for table in (second, near, links):
        release(table)

    classes = (members.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least_id"))
               .join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("label", "digest")))
    smallest = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = classes.select("digest", "component").join(smallest, "component")
    return (members.join(named, "digest", "left")
            .select(F.col("doc_id").alias(doc_id), "n_shingles",
                    F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    F.col("digest").alias("class"), "component", "text_key"))


def keep_one(documents, n=5, percent=75, doc_id="doc_id", text="text"):
    """One row of each group of near copies, with its own columns: the one with the smallest doc_id (null last), then the
    smallest text and other columns. Texts without words are in no group and all stay."""
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")
    groups = near_duplicates(documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), n, percent, "id", "text")
    rows = groups.where("component IS NOT NULL").select("component", place.alias("place"))
    firsts = rows.groupBy("component").agg(F.min("place").alias("first"))
    gone = keys(rows.join(firsts, "component").where("place <> first").select("place").distinct())
    twice = keys(rows.groupBy("place").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("place"))
    keyed = (documents.select(F.col(doc_id).alias("id"), F.md5(F.col(text)).alias("text_key"), F.struct(*documents.columns).alias("row"))
             .select(place.alias("place"), "row").join(gone, "place", "left_anti"))
    repeated = keyed.join(twice, "place", "left_semi").groupBy("place").agg(F.min("row").alias("row"))
    return keyed.join(twice, "place", "left_anti").select("row.*").unionByName(repeated.select("row.*"))
