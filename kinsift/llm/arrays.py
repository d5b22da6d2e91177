"""Words of whole texts as numpy arrays of 64-bit hashes, for use inside Arrow tasks.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; A-Z are
lower-cased where asked. All documents of a piece are hashed together, without a Python loop over words.
Hashes have 64 bits: two different words or n-grams share one with a chance of about 5e-20.
"""
import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Text bytes hashed at once; bounds the temporary arrays of a task. A longer document is a piece of its own.
PIECE = 400_000


def mix(x):
    """Spread every input bit over all output bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base, n, kept={}):
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; the longest run asked for is kept."""
    if len(kept.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        kept[base] = np.cumprod(out, out=out)
    return kept[base][:n]


def byte_set(values):
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


#: What separates words; and, for comparing wordings, everything but ASCII letters, digits and bytes of other scripts.
SPACES = byte_set([9, 10, 11, 12, 13, 32])
PUNCTUATION = byte_set(b for b in range(128) if not chr(b).isalnum())
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A value with many bits set for each byte, so that short words do not start out alike.
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE))
_BYTE_LOWER = _BYTE[_LOWER]


def word_spans(data, separators=SPACES):
    """(first byte, end byte) of every word in a byte array."""
    word = ~separators[data]
    edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def word_hashes(texts, lower=True, separators=SPACES):
    """(hashes of all words, number of the first word of each text, then of the end). Texts are bytes or None."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.frombuffer(b" ".join(t or b"" for t in texts), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    first, end = word_spans(data, separators)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    values = (_BYTE_LOWER if lower else _BYTE)[data]
    values *= _powers(BASE, len(data))
    np.cumsum(values, out=total[1:])
    hashes = (total[end] - total[first]) * _powers(BASE_INVERSE, len(data))[first]
    return mix(hashes + (end - first).astype(np.uint64)), np.searchsorted(first, starts)


def grams(hashes, n):
    """Hashes of all runs of n neighbouring words."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    size = len(hashes) - n + 1
    out = hashes[:size].copy()
    for k in range(1, n):
        out *= np.uint64(BASE)
        out += hashes[k:size + k]
    return mix(out)


def shingle_set(hashes, n):
    """Sorted distinct n-word shingles of a text; a shorter text is one shingle, an empty one has none."""
    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    return np.unique(grams(hashes, min(n, len(hashes))) + np.uint64(0 if len(hashes) >= n else len(hashes)))


def pieces(column, size=PIECE):
    """Split an Arrow string column into (offset, list of bytes) pieces of about `size` bytes of text."""
    import pyarrow as pa

    values = column.cast(pa.large_binary()).to_pylist() if column.type != pa.large_binary() else column.to_pylist()
    start, held = 0, 0
    for i, value in enumerate(values):
        long = len(value or b"")
        if held and held + long > size:
            yield start, values[start:i]
            start, held = i, 0
        held += long
    if start < len(values):
        yield start, values[start:]
