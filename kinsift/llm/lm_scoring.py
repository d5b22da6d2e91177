"""Scoring texts with a deleted-interpolation language model trained on the corpus itself.

P(w | v) = a * c(v w) / c(v) + b * c(w) / N + (1 - a - b) / (V + 1), with weights for each bucket of context frequency (octaves
of c(v)), learned by expectation-maximisation on held-out counts: counts of one part of the training documents, under the maximum
likelihood estimates of the others. The final estimates use all training documents.

How it runs:
1. Word counts: folded in each task, then one grouping.
2. The HOT most frequent words get numbers and are known to every task; all others go by 64-bit hash.
3. Pair counts: each task folds its word pairs; the folded pairs are dealt to blocks by pair (by first word, if that is rare), packed
   in sorted, delta-coded arrays. A block knows all counts of its pairs and yields held-out counts by probability.
4. EM over those held-out counts, at most 41 * 321 * 321 cells, whatever the input.
5. Scores: pairs are dealt to blocks again, now with their documents; a block counts its pairs and returns each document's sum.
   Pairs with more than N / HEAVY occurrences (at most HEAVY of them) are known from step 3 and scored where they stand, so no
   block receives the documents of a very frequent pair.
6. Words that are not hot meet their counts by an equi-join.
"""
import hashlib

import numpy as np
from pyspark.sql import functions as F

from kinsift.llm.arrays import BASE, mix, pieces, word_hashes
from kinsift.llm.common import arrow_rows
from kinsift.session import materialise

#: Words that every task knows (12 MB), pairs that every task knows (1 MB), tokens that a block holds on average.
HOT, HEAVY, BLOCK_TOKENS = 1 << 19, 1 << 16, 1_000_000
#: Text bytes whose pairs a task folds at once. With more memory than the 3 GB that this was measured in, raise both together: fewer,
#: larger blocks and pieces mean fewer rows in the shuffle.
FOLD_BYTES = 2_000_000
#: Texts that a task takes from Spark at once; under 65 536, so that a text's place in a piece has two bytes.
BATCH_ROWS = 1_000
END = np.uint64(0x5851F42D4C957F2D)
RARE = np.uint64(1 << 63)
PER_OCTAVE, OCTAVES = 8, 40
FOLDS, HELD_OUT, TUNING = 7, 2, 3


def _batches(column):
    """(hashes, words of each text, its rows of the batch) in pieces of FOLD_BYTES; every text ends in END."""
    for offset, texts in pieces(column, FOLD_BYTES):
        parts, lengths, at = [], [], 0
        size = 0
        for i, t in enumerate(texts):
            size += len(t or b"")
            if size > 400_000 or i + 1 == len(texts):
                hashes, first = word_hashes(texts[at:i + 1])
                counts = np.diff(first)
                ended = np.insert(hashes & ~RARE, first[1:], END & ~RARE)
                parts.append(ended)
                lengths.append(counts + 1)
                at, size = i + 1, 0
        lengths = np.concatenate(lengths)
        yield np.concatenate(parts), lengths, slice(offset, offset + len(texts))


def _pack(values):
    """Sorted 64-bit numbers as differences, byte planes apart, so that the shuffle's compression finds the zeros."""
    return np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data):
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


class Words:
    """The hot words: sorted hashes, and their counts in all training texts and in those that EM estimates from."""

    def __init__(self, hashes, train, fit):
        order = np.argsort(hashes)
        self.hashes, self.train, self.fit = hashes[order], train[order], fit[order]

    def ids(self, hashes):
        """Number of a hot word, or the hash with its top bit set."""
        if not len(self.hashes):
            return hashes | RARE
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at.astype(np.uint64), hashes | RARE)


def _pairs(hashes, lengths, words):
    """(context id, word id) of every token; the first of a text has END as its context."""
    w = words.ids(hashes)
    v = np.concatenate([w[-1:], w[:-1]]) if len(w) else w
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    v[starts] = words.ids(np.array([END & ~RARE]))[0]
    return v, w


def _blocks_of(v, w, blocks):
    """Pairs with a hot context are dealt by pair, those with a rare one by context, whose count is then local."""
    return (np.where(v < RARE, mix(v * np.uint64(BASE) + w), mix(v)) % np.uint64(blocks)).astype(np.int64)


def _buckets(counts):
    return np.minimum(np.log2(counts + 1.0).astype(np.int64), OCTAVES)


def _cells(p):
    """Cell of a probability: 0 for none, else by eighths of an octave."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(1 + (-np.log2(p) * PER_OCTAVE), 1, PER_OCTAVE * OCTAVES), 0).astype(np.int64)


def _cell_value(cell):
    return np.where(cell > 0, 2.0 ** (-(cell - 0.5) / PER_OCTAVE), 0.0)


def learn(table, vocabulary, rounds=30):
    """Weights (pair, word, uniform) by context bucket, by EM; `table` has bucket, cell2, cell1 and n.

    A tenth of a count stands behind each weight, so none is zero; a bucket without held-out counts gets equal shares.
    """
    bucket, n = table["bucket"].astype(np.int64), table["n"].astype(float)
    p = np.stack([_cell_value(table["cell2"]), _cell_value(table["cell1"]), np.full(len(n), 1.0 / (vocabulary + 1))], axis=1)
    weights = np.full((OCTAVES + 1, 3), 1 / 3)
    for _ in range(rounds):
        shares = weights[bucket] * p
        shares *= (n / shares.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(bucket, shares[:, k], OCTAVES + 1) for k in range(3)], axis=1) + 0.1
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def _folds(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS))


def _count_words(docs):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            for hashes, lengths, rows in _batches(batch.column(1)):
                fold = np.repeat(folds[rows], lengths)
                found, inverse = np.unique(hashes[fold != HELD_OUT], return_inverse=True)
                tuning = np.bincount(inverse, fold[fold != HELD_OUT] == TUNING, len(found)).astype(np.int64)
                train = np.bincount(inverse, minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(train), pa.array(train - tuning)], names=["word", "train", "fit"])

    rows = docs.select("fold", "body").mapInArrow(run, "word long, train long, fit long")
    return rows.groupBy("word").agg(F.sum("train").alias("train"), F.sum("fit").alias("fit"))


def _hot_words(counts):
    """The most frequent words down to the lowest eighth of an octave at which they are no more than HOT."""
    level = F.floor(F.log2(F.col("train")) * PER_OCTAVE)
    steps = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["level"])
    total, lowest = 0, None
    for step in steps:
        total += step["n"]
        if total > HOT:
            break
        lowest = step["level"]
    if lowest is None:
        return Words(*[np.empty(0, dtype=t) for t in (np.uint64, np.int64, np.int64)])
    table = counts.where(level >= lowest).toArrow()
    return Words(table["word"].to_numpy().view(np.uint64), table["train"].to_numpy(), table["fit"].to_numpy())


_FOLDED = ["block", "codes", "code_fit", "code_tuning", "v", "w", "fit", "tuning"]


def _fold_pairs(docs, words, blocks):
    """Distinct training pairs of each piece of text with their counts, packed by block."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            for hashes, lengths, rows in _batches(batch.column(1)):
                v, w = _pairs(hashes, lengths, words.value)
                fold = np.repeat(folds[rows], lengths)
                use = fold != HELD_OUT
                v, w, tuning = v[use], w[use], fold[use] == TUNING
                block = _blocks_of(v, w, blocks)
                hot = (v < RARE) & (w < RARE)
                out = {}
                code = (v[hot] << np.uint64(20)) | w[hot]
                found, inverse = np.unique(code, return_inverse=True)
                for_tuning = np.bincount(inverse, tuning[hot], len(found)).astype(np.uint32)
                for_fit = (np.bincount(inverse, minlength=len(found)) - for_tuning).astype(np.uint32)
                home = _blocks_of(found >> np.uint64(20), found & np.uint64((1 << 20) - 1), blocks)
                for b, at in _split(home):
                    out[b] = [_pack(found[at]), for_fit[at].tobytes(), for_tuning[at].tobytes()]
                v, w, tuning, block = v[~hot], w[~hot], tuning[~hot], block[~hot]
                for b, at in _split(block):
                    out.setdefault(b, [b"", b"", b""]).extend([v[at].tobytes(), w[at].tobytes(), (~tuning[at]).astype(np.uint32).tobytes(), tuning[at].astype(np.uint32).tobytes()])
                if out:
                    cells = [(b, *(x + [b""] * (7 - len(x)))) for b, x in out.items()]
                    columns = list(zip(*cells))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]], names=_FOLDED)

    return docs.select("fold", "body").mapInArrow(run, "block int, " + ", ".join(f"{c} binary" for c in _FOLDED[1:]))


def _split(block):
    """(block, places in order) for each block that occurs."""
    order = np.argsort(block, kind="stable")
    found, first = np.unique(block[order], return_index=True)
    for b, at in zip(found.tolist(), np.split(order, first[1:])):
        yield b, at


def _joined(table, name, dtype):
    return np.concatenate([np.frombuffer(x, dtype=dtype) for x in table[name].to_pylist()] or [np.empty(0, dtype=dtype)])


def _sum_by(keys, *values):
    found, inverse = np.unique(keys, return_inverse=True)
    return found, inverse, [np.bincount(inverse, x, len(found)).astype(np.int64) for x in values]


def _held_out_counts(folded, words, n_fit, heavy_at):
    """Rows of kind 0: held-out counts by (bucket, cell2, cell1); 1: the same without cell1, for a rare word; 2: heavy pairs."""
    schema = "kind int, key long, bucket int, cell2 int, cell1 int, n long, m long"

    def run(table):
        import pyarrow as pa

        known = words.value
        rows = [[] for _ in range(7)]

        def add(kind, key, bucket, cell2, cell1, n, m):
            for column, value in zip(rows, (np.full(len(n), kind), key, bucket, cell2, cell1, n, m)):
                column.append(np.asarray(value, dtype=np.int64))

        def told(w, bucket, p2, n):
            """Fold held-out counts to cells."""
            rare = w >= RARE
            cell2 = _cells(p2)
            cell1 = _cells(known.fit[w[~rare].astype(np.int64)] / max(1, n_fit))
            key, _, (total,) = _sum_by((bucket[~rare] * 1000 + cell2[~rare]) * 1000 + cell1, n[~rare])
            add(0, np.zeros(len(key)), key // 1_000_000, key // 1000 % 1000, key % 1000, total, np.zeros(len(key)))
            add(1, (w[rare] & ~RARE).view(np.int64), bucket[rare], cell2[rare], np.zeros(rare.sum()), n[rare], np.zeros(rare.sum()))

        codes = np.concatenate([_unpack(x) for x in table["codes"].to_pylist()] or [np.empty(0, dtype=np.uint64)])
        codes, _, (fit, tuning) = _sum_by(codes, _joined(table, "code_fit", np.uint32), _joined(table, "code_tuning", np.uint32))
        heavy = fit + tuning >= heavy_at
        add(2, codes[heavy].view(np.int64), *[np.zeros(heavy.sum())] * 3, fit[heavy] + tuning[heavy], np.zeros(heavy.sum()))
        v, w = (codes >> np.uint64(20)).astype(np.int64), codes & np.uint64((1 << 20) - 1)
        use = tuning > 0
        context = known.fit[v[use]]
        told(w[use], _buckets(context), fit[use] / np.maximum(1, context), tuning[use])

        v, w = _joined(table, "v", np.uint64), _joined(table, "w", np.uint64)
        fits, tunings = _joined(table, "fit", np.uint32), _joined(table, "tuning", np.uint32)
        if len(v):
            _, of_v, (context,) = _sum_by(v, fits)
            context = np.where(v < RARE, known.fit[np.where(v < RARE, v, 0).astype(np.int64)] if len(known.fit) else 0, context[of_v])
            _, of_pair, (fit, tuning) = _sum_by(mix(v * np.uint64(BASE) + w), fits, tunings)
            _, once = np.unique(of_pair, return_index=True)
            once = once[tuning[of_pair[once]] > 0]
            told(w[once], _buckets(context[once]), fit[of_pair[once]] / np.maximum(1, context[once]), tuning[of_pair[once]])
        columns = [np.concatenate(c) for c in rows]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], names=["kind", "key", "bucket", "cell2", "cell1", "n", "m"])

    return folded.groupBy("block").applyInArrow(run, schema)


class Model:
    """All that scoring a pair needs: hot words, weights, totals, heavy pairs."""

    def __init__(self, words, weights, total, vocabulary, heavy, heavy_n):
        order = np.argsort(heavy)
        self.words, self.weights, self.total, self.vocabulary = words, weights, total, vocabulary
        self.heavy, self.heavy_n = heavy[order], heavy_n[order]

    def base(self, counts):
        return np.log10((counts + 1.0) / (self.total + self.vocabulary + 1.0))

    def parts(self, pair, context):
        """(the part of the probability that does not depend on the word's count, the factor of that count)."""
        a = self.weights[_buckets(context)]
        return a[:, 0] * pair / np.maximum(1, context) + a[:, 2] / (self.vocabulary + 1), a[:, 1] / max(1, self.total)

    def score(self, pair, context, word):
        fixed, factor = self.parts(pair, context)
        return np.log10(fixed + factor * word)


_DEALT = ["block", "piece", "place", "fold", "codes", "code_doc", "v", "w", "doc"]
_OWN = "piece long, place long, key1 long, key2 long, base double, score double, n_tokens long, n_known long"
_SCORED = "kind int, piece long, place long, word long, score double, factor double"


def _names(schema):
    return [c.split()[0] for c in schema.split(", ")]


def _small(values):
    """Numbers under 65 536 as two byte planes."""
    return values.astype(np.uint16).view(np.uint8).reshape(-1, 2).T.tobytes()


def _small_back(data):
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(2, -1).T).view(np.uint16).ravel().astype(np.int64)


def _deal_pairs(docs, model, blocks):
    """Pairs with their documents, packed by block; block -1 has what a task could score itself.

    A document goes by its place in a piece, and a piece by a digest of its documents' keys, so that equal pieces stay equal
    when a task runs again."""
    def run(batches):
        import pyarrow as pa

        m = model.value
        for batch in batches:
            key1, key2, folds = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for hashes, lengths, rows in _batches(batch.column(3)):
                v, w = _pairs(hashes, lengths, m.words)
                doc = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
                hot_word = w < RARE
                at = w[hot_word].astype(np.int64)
                base = np.bincount(doc[hot_word], m.base(m.words.train[at]), len(lengths))
                known = np.bincount(doc[hot_word], minlength=len(lengths)).astype(np.int64)
                score = np.zeros(len(lengths))
                hot = hot_word & (v < RARE)
                code = np.where(hot, (v << np.uint64(20)) | w, np.uint64(0))
                if len(m.heavy):
                    place = np.minimum(np.searchsorted(m.heavy, code), len(m.heavy) - 1)
                    done = hot & (m.heavy[place] == code)
                    got = m.score(m.heavy_n[place[done]], m.words.train[v[done].astype(np.int64)], m.words.train[w[done].astype(np.int64)])
                    score = np.bincount(doc[done], got, len(lengths))
                    v, w, doc, hot, code = v[~done], w[~done], doc[~done], hot[~done], code[~done]
                piece = hashlib.blake2b(key1[rows].tobytes() + key2[rows].tobytes(), digest_size=8).digest()
                out = [(-1, piece, key1[rows].tobytes(), key2[rows].tobytes(), base.tobytes(), score.tobytes(), lengths.astype(np.int64).tobytes(), known.tobytes(), b"")]
                block = _blocks_of(v, w, blocks)
                for b, places in _split(block):
                    here, own = np.unique(doc[places], return_inverse=True)
                    pair = hot[places]
                    order = np.argsort(code[places][pair], kind="stable")
                    rest = places[~pair]
                    out.append((b, piece, _small(here), folds[rows][here].astype(np.uint8).tobytes(),
                                _pack(code[places][pair][order]), _small(own[pair][order]), v[rest].tobytes(), w[rest].tobytes(), _small(own[~pair])))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]], names=_DEALT)

    return docs.select("key1", "key2", "fold", "body").mapInArrow(run, "block int, " + ", ".join(f"{c} binary" for c in _DEALT[1:]))


def _own_scores(dealt):
    """What tasks scored themselves, as rows."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                piece, key1, key2, base, score, n, known = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=t) for c, t in (
                    (1, np.int64), (2, np.int64), (3, np.int64), (4, np.float64), (5, np.float64), (6, np.int64), (7, np.int64)))
                columns = [np.full(len(n), piece[0]), np.arange(len(n)), key1, key2, base, score, n, known]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_names(_OWN))

    return dealt.mapInArrow(run, _OWN)


def _block_scores(dealt, model):
    """Kind 0: a document's sum over the block's pairs; 1: a pair whose word is rare, still without the word's count."""
    def run(table):
        import pyarrow as pa

        m = model.value
        fold = _joined(table, "fold", np.uint8)
        sizes = [len(x) for x in table["fold"].to_pylist()]
        piece = np.repeat(_joined(table, "piece", np.int64), sizes)
        place = np.concatenate([_small_back(x) for x in table["place"].to_pylist()] or [np.empty(0, dtype=np.int64)])
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if sizes else np.empty(0, dtype=np.int64)

        def documents(name):
            parts = [_small_back(x) + o for x, o in zip(table[name].to_pylist(), offsets)]
            return np.concatenate(parts or [np.empty(0, dtype=np.int64)])

        codes = np.concatenate([_unpack(x) for x in table["codes"].to_pylist()] or [np.empty(0, dtype=np.uint64)])
        doc = documents("code_doc")
        found, of, (pair,) = _sum_by(codes, fold[doc] != HELD_OUT)
        v, w = (found >> np.uint64(20)).astype(np.int64), (found & np.uint64((1 << 20) - 1)).astype(np.int64)
        value = m.score(pair, m.words.train[v], m.words.train[w]) if len(found) else np.empty(0)
        score = np.bincount(doc, value[of], len(piece)) if len(doc) else np.zeros(len(piece))

        v, w, doc = _joined(table, "v", np.uint64), _joined(table, "w", np.uint64), documents("doc")
        rare = w >= RARE
        fixed = factor = np.empty(0)
        if len(v):
            train = fold[doc] != HELD_OUT
            _, of_v, (context,) = _sum_by(v, train)
            context = np.where(v < RARE, m.words.train[np.where(v < RARE, v, 0).astype(np.int64)] if len(m.words.train) else 0, context[of_v])
            _, of_pair, (pair,) = _sum_by(mix(v * np.uint64(BASE) + w), train)
            fixed, factor = m.parts(pair[of_pair], context)
            hot = ~rare
            got = np.log10(fixed[hot] + factor[hot] * m.words.train[w[hot].astype(np.int64)]) if hot.any() else np.empty(0)
            score = score + np.bincount(doc[hot], got, len(piece)) if hot.any() else score
            fixed, factor, doc, w = fixed[rare], factor[rare], doc[rare], w[rare]
        n, k = len(piece), len(doc) if len(v) else 0
        doc, w = (doc, w) if len(v) else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64))
        columns = [np.concatenate([np.zeros(n), np.ones(k)]).astype(np.int32), np.concatenate([piece, piece[doc]]), np.concatenate([place, place[doc]]),
                   np.concatenate([np.zeros(n, dtype=np.int64), (w & ~RARE).view(np.int64)]), np.concatenate([score, fixed]), np.concatenate([np.zeros(n), factor])]
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=_names(_SCORED))

    return dealt.groupBy("block").applyInArrow(run, _SCORED)


def train(docs):
    """(model, counts): `docs` has fold and body. Counts, word table and pair counts cover all training documents."""
    counts = materialise(_count_words(docs))
    total, n_fit, vocabulary = (x or 0 for x in counts.agg(F.sum("train"), F.sum("fit"), F.count(F.lit(1))).first())
    words = _hot_words(counts)
    context = docs.sparkSession.sparkContext
    blocks = max(1, -(-total // BLOCK_TOKENS))
    known = context.broadcast(words)
    told = materialise(_held_out_counts(_fold_pairs(docs, known, blocks), known, n_fit, max(2, total // HEAVY + 1)))
    heavy = told.where("kind = 2").select("key", "n").toArrow()
    of_rare = (told.where("kind = 1").join(counts, F.col("key") == F.col("word")).withColumn("p1", F.col("fit") / F.lit(float(max(1, n_fit))))
               .select("bucket", "cell2", F.when(F.col("p1") > 0, F.greatest(F.lit(1), F.least(F.lit(PER_OCTAVE * OCTAVES),
                       F.floor(1 - F.log2("p1") * PER_OCTAVE)))).otherwise(0).cast("int").alias("cell1"), "n"))
    cells = (told.where("kind = 0").select("bucket", "cell2", "cell1", "n").unionByName(of_rare)
             .groupBy("bucket", "cell2", "cell1").agg(F.sum("n").alias("n")).toArrow())
    weights = learn({c: cells[c].to_numpy() for c in ("bucket", "cell2", "cell1", "n")}, vocabulary)
    return Model(words, weights, total, vocabulary, heavy["key"].to_numpy().view(np.uint64), heavy["n"].to_numpy()), counts


def _run(docs):
    """All jobs of a run: (model, word counts, rows that tasks scored, rows of the blocks)."""
    model, counts = train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    blocks = max(1, -(-model.total // BLOCK_TOKENS))
    dealt = _deal_pairs(docs, sent, blocks)
    own = materialise(_own_scores(dealt.where("block = -1")))
    apart = materialise(_block_scores(dealt.where("block >= 0"), sent))
    return model, counts, own, apart


def score(documents, doc_id="doc_id", text="text"):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Documents with crc32(id as text) mod 7 = 2 are held out; all others train, those with remainder 3 also tune the weights. Tokens
    are words (split at ASCII white space, A-Z lower-cased) and one end. base_score is the add-one unigram score, score
    the model's log10 probability of the whole text. A null text is empty and scores its end alone; a null id counts as the empty text for its
    remainder; repeated rows all train and score alike; an empty table gives an empty result; other columns are not looked at.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), _folds(F.col(doc_id)).cast("int").alias("fold"), F.col(text).alias("body"),
                            F.xxhash64(F.lit("a"), F.col(doc_id), F.col(text)).alias("key1"), F.xxhash64(F.lit("b"), F.col(text), F.col(doc_id)).alias("key2"))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        model, counts, own, apart = _run(docs)
    c = F.coalesce("train", F.lit(0))
    rare = (apart.where("kind = 1").join(counts.select("word", "train"), "word", "left")
            .select("piece", "place", F.log10((c + 1.0) / F.lit(float(model.total + model.vocabulary + 1))).alias("base"),
                    F.log10(F.col("score") + F.col("factor") * c).alias("score"), (c > 0).cast("long").alias("n_known")))
    parts = (own.withColumn("copies", F.lit(1)).unionByName(apart.where("kind = 0").select("piece", "place", "score"), allowMissingColumns=True)
             .unionByName(rare, allowMissingColumns=True))
    # Equal pieces share their places, so sums come out as many times too large as there are copies.
    sums = parts.groupBy("piece", "place").agg(F.max("key1").alias("key1"), F.max("key2").alias("key2"), *[F.sum(x).alias(x) for x in (
        "base", "score", "n_tokens", "n_known", "copies")])
    each = [(F.col(a) / F.col("copies")).cast(kind).alias(b) for a, b, kind in (
        ("n_tokens", "n_tokens", "long"), ("n_known", "n_known", "long"), ("base", "base_score", "double"), ("score", "score", "double"))]
    # Rows with the same id and text share a key and, but for the order of summing, their sums.
    named = sums.select("key1", "key2", *each)
    named = named.groupBy("key1", "key2").agg(*[F.min(x).alias(x) for x in named.columns[2:]])
    return (docs.select("doc_id", "fold", "key1", "key2").join(named, ["key1", "key2"])
            .select(F.col("doc_id").alias(doc_id), (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
                    F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"))
