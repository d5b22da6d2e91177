"""Quality of texts from random-indexing word vectors and a small network.

Every unit (a word, or the shape of a word) owns a fixed sparse random vector; the vector of a unit is the sum of the random vectors of
all units that stand up to WINDOW places from it anywhere in the corpus. Units are hashed to a fixed number of rows, so what the tasks send
is folded to one table of fixed size, whatever the vocabulary. A document is the mean and the spread of its units' vectors;
a two-layer network, trained with numpy on a bounded sample of labelled documents, turns them into a logit. A temperature fitted on
labelled documents that the training did not see makes a probability of it.
"""
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinsift.llm.common import arrow_rows
from kinsift.session import materialise

#: Rows for words and for shapes, components of a vector, places a neighbour is away at most, entries of a random vector.
WORD_ROWS, SHAPE_ROWS, AXES, WINDOW, ENTRIES = 1 << 13, 1 << 10, 64, 2, 4
ROWS = WORD_ROWS + SHAPE_ROWS
#: Labelled documents that the network learns from at most: those with the smallest hash of their id. A fifth sets the temperature.
SAMPLE = 8192
HIDDEN, STEPS, RATE, DECAY, SEED = 32, 400, 0.01, 1e-3, 11
#: Places that are counted at once.
SLICE = 1 << 15
SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


def random_vectors():
    """(axes, signs) of every unit's random vector: ENTRIES axes each, half of them +1 and half -1."""
    draw = np.random.default_rng(SEED)
    axes = np.argsort(draw.random((ROWS, AXES)), 1)[:, :ENTRIES]
    return axes, np.tile(np.array([1.0, -1.0] * (ENTRIES // 2)), (ROWS, 1))


def dense_vectors():
    """The random vectors as a table, with a last row of zeros for places between texts."""
    axes, signs = random_vectors()
    table = np.zeros((ROWS + 1, AXES), np.int16)
    np.put_along_axis(table[:ROWS], axes, signs.astype(np.int16), 1)
    return table


def unit_rows(text):
    """Rows of the words of a text, and of their shapes: letters, capitals, digits and signs with repeats taken once."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.lower().split()
    kinds = np.frombuffer(data.translate(SHAPE), np.uint8)
    shapes = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])].tobytes().split() if len(kinds) else []
    count = len(words)
    return (np.fromiter(map(crc32, words), np.int64, count) % WORD_ROWS,
            np.fromiter(map(crc32, shapes), np.int64, count) % SHAPE_ROWS + WORD_ROWS)


def add_contexts(total, words, shapes, vectors):
    """Add to `total` (ROWS x AXES) for every place the random vectors of its neighbours; WINDOW places of -1 separate texts."""
    for start in range(0, len(words), SLICE):
        low, high = max(start - WINDOW, 0), min(start + SLICE + WINDOW, len(words))
        here = vectors[words[low:high]] + vectors[shapes[low:high]]
        around = np.zeros_like(here)
        for off in range(1, WINDOW + 1):
            around[off:] += here[:-off]
            around[:-off] += here[off:]
        inside = slice(start - low, min(start + SLICE, len(words)) - low)
        around = around[inside]
        for rows in (words[low:high][inside], shapes[low:high][inside]):
            order = np.argsort(rows, kind="stable")
            order = order[np.searchsorted(rows[order], 0):]
            if len(order):
                ordered = rows[order]
                first = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1])
                total[ordered[first]] += np.add.reduceat(around[order], first, 0, dtype=np.int32)


def _fold_contexts(batches):
    vectors = dense_vectors()
    total, seen = np.zeros((ROWS, AXES), np.int64), np.zeros(ROWS)
    gap = np.full(WINDOW, -1, np.int64)
    for batch in batches:
        parts = [unit_rows(text) for text in batch.column("text").to_pylist()]
        words = np.concatenate([x for w, _ in parts for x in (w, gap)])
        shapes = np.concatenate([x for _, s in parts for x in (s, gap)])
        add_contexts(total, words, shapes, vectors)
        seen += np.bincount(np.concatenate([words[words >= 0], shapes[words >= 0]]), minlength=ROWS)
    some = np.flatnonzero(seen)
    sums = total[some]
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some].astype(np.int64)), pa.array(list(sums), pa.list_(pa.int64()))],
                                     ["unit", "n", "sums"])


def word_vectors(texts):
    """ROWS x AXES table of unit vectors over all of `texts` (text): length one, without what all of them have in common."""
    found = texts.mapInArrow(_fold_contexts, "unit int, n long, sums array<long>").groupBy("unit").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(AXES)]).alias("sums")).toArrow()
    table, weight = np.zeros((ROWS, AXES)), np.zeros(ROWS)
    if found.num_rows:
        at = found.column("unit").to_numpy()
        rows = found.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, AXES).astype(float)
        table[at] = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        weight[at] = found.column("n").to_numpy()
        table[at] -= weight @ table / weight.sum()
    return table.astype(np.float32)


def pooled(text, table, squares):
    """Mean and spread of the word vectors and of the shape vectors of a text, and the logarithm of its length."""
    out = []
    words, shapes = unit_rows(text)
    for rows in (words, shapes):
        row, n = np.unique(rows, return_counts=True)
        share = (n / max(n.sum(), 1)).astype(np.float32)
        mean = share @ table[row]
        out += [mean, np.sqrt(np.maximum(share @ squares[row] - mean * mean, 0))]
    return np.concatenate([*out, [np.log1p(len(words))]]).astype(np.float32)


def train(x, y):
    """Weights of the network and its temperature; every fifth row only sets the temperature and the moment to stop."""
    check = np.arange(len(y)) % 5 == 4
    if len(y) < 2 or len(set(y[~check])) < 2:
        return None, (y.sum() + 1) / (len(y) + 2)
    middle, spread = x[~check].mean(0), np.maximum(x[~check].std(0), 1e-3)
    x = np.clip((x - middle) / spread, -8, 8).astype(float)
    draw = np.random.default_rng(SEED)
    net = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    own, aim = x[~check], y[~check]
    watched, truth = (x[check], y[check]) if check.any() else (own, aim)

    def loss(logit, t):
        return float(np.mean(np.logaddexp(0, logit) - t * logit))

    best = (np.inf, net)
    for step in range(1, STEPS + 1):
        inner = np.tanh(own @ net[0] + net[1])
        off = (1 / (1 + np.exp(-np.clip(inner @ net[2] + net[3], -50, 50))) - aim) / len(aim)
        back = np.outer(off, net[2]) * (1 - inner * inner)
        slopes = [own.T @ back + DECAY * net[0], back.sum(0), inner.T @ off + DECAY * net[2], np.array([off.sum()])]
        for i, slope in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.999 * second[i] + 0.001 * slope * slope
            net[i] = net[i] - RATE * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
        if step % 10 == 0:
            now = loss(np.tanh(watched @ net[0] + net[1]) @ net[2] + net[3][0], truth)
            if now < best[0]:
                best = (now, [p.copy() for p in net])
    net = best[1]
    logit = np.tanh(watched @ net[0] + net[1]) @ net[2] + net[3][0]
    heats = np.exp(np.linspace(-1.5, 2.5, 161))
    heat = heats[int(np.argmin([loss(logit / t, truth) for t in heats]))]
    return (middle, spread, net, heat), None


def probability(x, model, base):
    """Calibrated probability of label 1 for each row of features."""
    if model is None:
        return np.full(len(x), base)
    middle, spread, net, heat = model
    z = np.clip((x - middle) / spread, -8, 8)
    logit = np.tanh(z @ net[0] + net[1]) @ net[2] + net[3][0]
    return 1 / (1 + np.exp(-np.clip(logit / heat, -50, 50)))


def score_quality(documents, labels, doc_id="doc_id", text="text", label="quality", folds=5, sample=SAMPLE, threshold=0.3):
    """Per row of `documents`: doc_id, held_out, score, predicted.

    Word vectors come from all texts; labels only from rows of `labels` whose crc32(doc_id as text) mod `folds` is not 0, of which at
    most `sample` are used, those with the smallest hash of the id. Null labels are left out, and so is a document with contrary
    ones. A null text counts as empty and gets a score like any other; a null id is never held out; repeated rows get the same
    score; without labels of both kinds every score is the smoothed share of label 1; an empty table gives an empty one.
    Of `documents` only the two columns named are looked at.
    """
    remainder = F.crc32(F.col(doc_id).cast("string")) % folds
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type, id_name = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()
    known = (labels.where(F.col(label).isNotNull() & (remainder != 0)).groupBy(F.col(doc_id).alias("doc_id"))
             .agg(F.min(label).cast("double").alias("label"), F.max(label).cast("double").alias("other")).where("label = other"))
    chosen = known.select("doc_id", "label").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    with arrow_rows(documents.sparkSession, 64):
        table = word_vectors(docs.select("text"))

        def features(batches):
            squares = table * table
            for batch in batches:
                rows = [pooled(t, table, squares).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "x"])

        # At most `sample` keys: small enough to send to every task.
        learnt = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(features, f"doc_id {id_name}, label double, x binary")
        rows = learnt.groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").collect()
        x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), 4 * AXES + 1)
        model, base = train(x, np.array([r["label"] for r in rows], float))

        def rate(batches):
            squares = table * table
            for batch in batches:
                x = np.array([pooled(t, table, squares) for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, 4 * AXES + 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(id_type), pa.array(probability(x, model, base), pa.float64())], ["doc_id", "score"])

        scored = materialise(docs.mapInArrow(rate, f"doc_id {id_name}, score double"))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
