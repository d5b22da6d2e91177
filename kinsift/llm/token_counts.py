"""Token counts of a unigram vocabulary by dynamic programming over a trie of distinct pre-tokens.

Each task collects the distinct pre-tokens of its texts, sorts them into a trie, and walks the trie level by level: the best
score of a prefix is computed once for all pre-tokens that share it, and a pre-token's count is read where it ends.
The walk is vectorised over the nodes of a level. Nothing is shuffled.
"""
import numpy as np

from kinsift.llm.arrays import BASE, BASE_INVERSE, _powers, mix, pieces

MARK = "▁"  # put before a pre-token, as the vocabulary does
#: Distinct pre-tokens that a task remembers; beyond it the memory is emptied and refilled, and counts stay the same.
REMEMBERED = 1_000_000


def read_pieces(path):
    """[(piece, log score)] of a SentencePiece model file, read on the driver.

    The file orders pieces by merge rank, not by probability; Zipf's law turns a rank r into the score -ln(r + 2.7). Control,
    unknown and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [(model.id_to_piece(i), -float(np.log(rank + 2.7))) for rank, i in enumerate(plain)]


class Vocabulary:
    """Pieces by hash. A character that no piece covers becomes one token for each of its UTF-8 bytes."""

    def __init__(self, scored):
        best = {}
        for piece, score in scored:
            if piece:
                best[piece] = max(score, best.get(piece, score))
        names = sorted(best)
        values = np.array([best[p] for p in names], dtype=np.float64)
        codes, first = _codes(names)
        total = _running(codes)
        hashes = _between(total, first[:-1], first[1:])
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], values[order]
        self.longest = max((len(p) for p in names), default=0)
        self.unknown = (float(values.min()) if len(values) else 0.0) - 10.0

    def look_up(self, hashes):
        """Scores; minus infinity where there is no such piece."""
        if not len(self.hashes):
            return np.full(len(hashes), -np.inf)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.scores[at], -np.inf)


def _codes(names):
    """All code points in one array, and where each name starts, then the end."""
    sizes = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
    return np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def _running(codes):
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(codes)), out=total[1:])
    return total


def _between(total, start, end):
    return mix((total[end] - total[start]) * _powers(BASE_INVERSE, len(total))[start] + (end - start).astype(np.uint64))


def trie_counts(tokens, vocabulary):
    """Tokens of each distinct pre-token; `tokens` must be sorted. Ties of score go to fewer tokens."""
    codes, first = _codes(tokens)
    total, sizes = _running(codes), np.diff(first)
    out = np.zeros(len(tokens), dtype=np.int64)
    live = np.flatnonzero(sizes > 0)
    # How many leading characters each pre-token shares with the one before: those nodes exist already.
    shared = np.zeros(len(tokens), dtype=np.int64)
    same, depth = np.arange(1, len(tokens)), 0
    while len(same):
        same = same[(sizes[same] > depth) & (sizes[same - 1] > depth)]
        same = same[codes[first[same] + depth] == codes[first[same - 1] + depth]]
        shared[same] += 1
        depth += 1
    # best[-l], count[-l]: state of each live pre-token l characters back.
    best, count, depth = [np.zeros(len(live))], [np.zeros(len(live), dtype=np.int64)], 0
    while len(live):
        new = shared[live] <= depth
        new[0] = True
        node = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        word = live[at]
        end = first[word] + depth + 1
        code = codes[end - 1].astype(np.int64)
        width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        top, least = best[-1][at] + vocabulary.unknown * width, count[-1][at] + width
        known_single = vocabulary.look_up(_between(total, end - 1, end)) > -np.inf
        top[known_single] = -np.inf
        for back in range(1, min(len(best), vocabulary.longest) + 1):
            score = best[-back][at] + vocabulary.look_up(_between(total, end - back, end))
            n = count[-back][at] + 1
            better = (score > top) | ((score == top) & (n < least) & (score > -np.inf))
            top, least = np.where(better, score, top), np.where(better, n, least)
        best.append(top[node])
        count.append(least[node])
        ends = sizes[live] == depth + 1
        out[live[ends]] = count[-1][ends]
        best, count = best[-max(1, vocabulary.longest):], count[-max(1, vocabulary.longest):]
        if ends.any():
            # What comes after an ended pre-token shares no more with it than its length, so its nodes are new from here on.
            keep = ~ends
            live = live[keep]
            best, count = [b[keep] for b in best], [c[keep] for c in count]
        depth += 1
    return out


class Counter:
    """Counts of pre-tokens seen so far in a task."""

    def __init__(self, vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def count(self, texts):
        """(pre-tokens, tokens) of each text, which are bytes or None."""
        cut = [(t or b"").split() for t in texts]
        fresh = set().union(*cut).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
            fresh = set().union(*cut)
        if fresh:
            names = sorted((MARK + w.decode(), w) for w in fresh)
            self.known.update(zip([w for _, w in names], trie_counts([n for n, _ in names], self.vocabulary).tolist()))
        get = self.known.__getitem__
        return [(len(c), sum(map(get, c))) for c in cut]


def count_tokens(documents, scored, doc_id="doc_id", text="text"):
    """doc_id, n_words, n_tokens of every row, over whole texts.

    A pre-token is a run of characters other than ASCII white space, with a mark before it. Its tokens are the pieces of
    the segmentation with the highest total score; ties go to fewer tokens. Null and empty texts have none; an empty
    table gives an empty result; repeated rows are counted each; other columns are not looked at.
    """
    vocabulary = Vocabulary(scored)
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        counter = Counter(vocabulary)
        for batch in batches:
            rows = [x for _, texts in pieces(batch.column(1), 4_000_000) for x in counter.count(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
                                             names=["id", "n_words", "n_tokens"])

    counted = documents.select(documents[doc_id].alias("id"), documents[text].alias("body")).mapInArrow(run, f"id {kind}, n_words long, n_tokens long")
    return counted.withColumnRenamed("id", doc_id)
